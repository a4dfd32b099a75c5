"""Suffix arrays of many small texts at once, by linear grouping.

Phase 1 groups the suffixes of a text by their Lyndon prefix. The groups are taken in descending order; the
members of a group are taken out of the list of positions not yet handled, and each run of l of them is added to
the position before it, the previous smaller one: its group is split, those with longer runs
going higher. Where a member's run ends in the list is its next smaller suffix. Phase 2 emits the suffixes in
ascending order: each suffix emitted puts the positions whose next smaller suffix it is next into their
groups. Nothing is renamed and no smaller problem is solved in between.

One text at a time, each step would be a few operations on scalars; here every step is a few operations on arrays over
all texts, each text at its own highest group, so that texts of similar length should come together.
"""

from __future__ import annotations

import numpy as np


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after the other."""
    size = hi - lo
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total, dtype=np.int64) + np.repeat(lo - ends + size, size)


def suffix_arrays(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Positions of ``text``, in which those of each part [edges[i], edges[i + 1]) stand in the order of the part's suffixes."""
    n = len(text)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    end = n  # stands for the empty suffix of any part
    # groups by first character: a group's name is the place of its first slot
    sa = np.lexsort((text, owner)).astype(np.int64)
    key = owner[sa] * 65536 + text[sa]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.empty(n, np.int64)
    stop = np.zeros(n + 1, np.int64)  # of each group's name, the slot after its last
    group[sa] = np.repeat(new, np.diff(np.append(new, n)))
    stop[new] = np.append(new[1:], n)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    first, last = edges[:-1], edges[1:]
    after = np.arange(1, n + 2)
    after[last[last > first] - 1] = end
    before = np.arange(-1, n)
    before[first[last > first]] = -1
    member = np.zeros(n + 1, bool)
    smaller = np.full(n, end, np.int64)  # the next smaller suffix
    top = last.copy()  # slots from here on are handled
    alive = np.flatnonzero(last > first)
    while len(alive):
        lo = group[sa[top[alive] - 1]]
        s = sa[ranges(lo, top[alive])]
        top[alive] = lo
        alive = alive[lo > first[alive]]
        smaller[s] = after[s]
        member[s] = True
        p = before[s]
        while (inside := (p >= 0) & member[p]).any():
            p[inside] = before[p[inside]]
        closing = ~member[after[s]]
        nxt, prv = after[s[closing]], p[closing]
        real = nxt < end
        before[nxt[real]] = prv[real]
        real = prv >= 0
        after[prv[real]] = nxt[real]
        member[s] = False
        p = p[p >= 0]
        if not len(p):
            continue
        # split the groups of the positions before: by the length of the run, the others lowest
        p.sort()
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        run = np.diff(np.append(cut, len(p)))
        p = p[cut]
        if (run != 1).any():
            order = np.lexsort((run, group[p]))
        else:
            order = np.argsort(group[p], kind="stable")
        p, run = p[order], run[order]
        g = group[p]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        many = np.diff(np.append(head, len(g)))
        names = g[head]
        high = stop[names]
        low = high - many
        slots = ranges(low, high)
        # what stands in the slots meant for p moves to where p stood
        moved = sa[slots]
        member[p] = True
        out = moved[~member[moved]]
        was = place[p]
        vacant = was[was < np.repeat(low, many)]
        member[p] = False
        sa[vacant] = out
        place[out] = vacant
        sa[slots] = p
        place[p] = slots
        opens = np.concatenate([[True], (g[1:] != g[:-1]) | (run[1:] != run[:-1])])
        at = np.flatnonzero(opens)
        name = slots[at]
        sizes = np.diff(np.append(at, len(p)))
        stop[names] = low
        stop[name] = name + sizes
        group[p] = np.repeat(name, sizes)
    # phase 2: children of each suffix, by next smaller suffix
    children = np.argsort(smaller, kind="stable")
    child_edge = np.searchsorted(smaller[children], np.arange(n + 2))
    cursor = np.arange(n + 1)
    out = np.full(n, -1, np.int64)

    def emit(c: np.ndarray) -> None:
        g = group[c]
        spot = cursor[g]
        out[spot] = c
        cursor[g] = spot + 1

    # those that run to the end of their part are the least of their groups, one in each
    tail = children[child_edge[end] : child_edge[end + 1]]
    emit(tail)
    i = 0
    live = np.flatnonzero(last > first)
    while len(live):
        s = out[first[live] + i]
        c = children[ranges(child_edge[s], child_edge[s + 1])]
        if len(c):
            emit(c)
        i += 1
        live = live[first[live] + i < last[live]]
    return out
