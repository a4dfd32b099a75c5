"""The best rows of many questions over all that a task sees."""

from __future__ import annotations

import numpy as np


class Best:
    """The ``k`` best (score, ord) of each of ``n`` questions so far, of equals the smaller ord; all questions in three arrays."""

    def __init__(self, n: int, k: int):
        self.k, self.last = k, np.full(n, np.inf)
        self.q, self.worst, self.ord = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, worst: np.ndarray, ords: np.ndarray) -> None:
        """``worst`` are negative scores, rows for the questions ``at`` and columns for ``ords``; infinite ones don't count."""
        q, w, o = [self.q], [self.worst], [self.ord]
        for lo in range(0, len(at), 256):
            part, own = worst[lo : lo + 256], at[lo : lo + 256]
            take = min(self.k, part.shape[1])
            # all that tie with the last of the best are looked at, as ord decides between them
            last = np.minimum(np.partition(part, take - 1, axis=1)[:, take - 1], self.last[own])
            i, j = np.nonzero((part <= last[:, None]) & np.isfinite(part))
            q.append(own[i])
            w.append(part[i, j])
            o.append(ords[j])
        q, w, o = np.concatenate(q), np.concatenate(w), np.concatenate(o)
        order = np.lexsort((o, w, q))
        q, w, o = q[order], w[order], o[order]
        start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else q
        kept = place < self.k
        self.q, self.worst, self.ord = q[kept], w[kept], o[kept]
        full = place[kept] == self.k - 1
        self.last[self.q[full]] = self.worst[full]
