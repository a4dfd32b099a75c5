"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's features are the n-grams that it has, not how often: words, runs of
digits, runs of marks, pairs of neighbouring tokens, and runs of 2, 3, ... equal tokens whatever
the token. Each indicator is scaled by its log-count ratio between the classes (naive Bayes), and
a linear model with hinge loss is fitted to the scaled indicators by dual coordinate descent. A
sigmoid fitted on rows held back turns the margin into a score from 0 to 1.

The model is fitted by one task, on a bounded sample (``max_rows``) of the labelled rows: the sample is sent to it twice, in the
same order, and it holds a batch of texts at a time, and of each text the numbers of its n-grams. The driver gets, and sends
to the executors, at most ``max_grams`` n-grams with their weights. Of labelled rows with equal text one is used. Every row is scored, on its whole text.

Defined results: null text is the empty text, whose score follows from the intercept; with no labelled
rows, or rows of one label only, every score is that label's share (0.5 without rows); rows that repeat get
the same score; an empty table gives no rows; other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.sample import labelled_sample, remainder

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
RUN = 8
#: What the fitting task returns.
FITTED = [
    ("grams", pa.list_(pa.string())),
    ("weights", pa.list_(pa.float64())),
    ("bias", pa.float64()),
    ("slope", pa.float64()),
    ("shift", pa.float64()),
    ("flat", pa.float64()),
]


def grams(text: str) -> set[str]:
    """The n-grams that a text has."""
    t = TOKEN.findall(text.lower())
    out = set(t)
    out.update({f"{a} {b}" for a, b in set(zip(t, t[1:], strict=False))})
    if len(t) > 1:
        number: dict[str, int] = {}
        a = np.fromiter((number.setdefault(x, len(number)) for x in t), np.int64, len(t))
        same = np.concatenate([[False], a[1:] == a[:-1], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        longest = int((edge[1::2] - edge[::2]).max()) + 1 if len(edge) else 1
        out.update(f"= = {n}" for n in range(2, min(longest, RUN) + 1))
        if (edge[2::2] - edge[1:-1:2] == 1).any():
            out.add("= = + = =")  # two runs side by side
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    slope: float
    shift: float
    flat: float | None = None

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        if self.flat is not None:
            return np.array([self.flat for _ in texts], np.float64)
        known, w = self.weights.keys(), self.weights
        margins = np.fromiter((math.fsum(map(w.__getitem__, known & grams(t or ""))) + self.bias for t in texts), np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -35, 35)))


def log_count_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """For each indicator, the logarithm of its smoothed share of the positive rows over that of the negative ones."""
    return np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of the linear model with hinge loss; ``rows`` have the places of the indicators that are 1, whose values are ``scale``."""
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    norm = np.array([float(scale[at] @ scale[at]) for at in rows])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if norm[i] == 0:
                continue
            at = rows[i]
            v = scale[at]
            g = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid of margins, by Newton's method on smoothed labels."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(sample: DataFrame, *, min_rows: int = 5, max_grams: int = 100_000, cost: float = 1.0) -> Model:
    """Fit on ``sample(text, label, hash)``, read twice in the order of the hashes: for counts by hash, then for the n-grams kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((again.as_py(), text.as_py(), label.as_py()) for b in batches for again, text, label in zip(b["again"], b["text"], b["label"], strict=True))
        passes = (((text, label) for _, text, label in own) for _, own in groupby(rows, itemgetter(0)))
        m = fit_rows(passes, min_rows, max_grams, cost)
        row = {"grams": list(m.weights), "weights": list(m.weights.values()), "bias": m.bias, "slope": m.slope, "shift": m.shift, "flat": m.flat}
        yield pa.RecordBatch.from_pylist([row], pa.schema(FITTED))

    twice = sample.select("hash", "text", "label", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    model = twice.repartition(1).sortWithinPartitions("again", "hash").mapInArrow(run, "grams array<string>, weights array<double>, bias double, slope double, shift double, flat double")
    found = model.head()
    return Model(dict(zip(found["grams"], found["weights"], strict=True)), *found[2:]) if found else Model({}, 0.0, 1.0, 0.0, flat=0.5)


def fit_rows(passes: Iterator[Iterator[tuple[str, int]]], min_rows: int, max_grams: int, cost: float) -> Model:
    """Fit on texts and labels that come twice in the same order; no passes if there are no rows."""
    buckets = 1 << 22
    counts, positive, total = np.zeros(buckets, np.int32), 0, 0
    for text, label in next(passes, ()):
        positive, total = positive + label, total + 1
        counts[np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams(text)), np.int64))] += 1
    if positive in (0, total):
        return Model({}, 0.0, 1.0, 0.0, flat=positive / total if total else 0.5)
    number: dict[str, int] = {}  # of the n-grams that may be kept; texts are held as numbers, not strings
    docs: list[tuple[int, np.ndarray]] = []
    for text, label in next(passes):
        kept = sorted(g for g in grams(text) if counts[zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets] >= min_rows)
        docs.append((label, np.array([number.setdefault(g, len(number)) for g in kept], np.int32)))
    del counts
    n_pos, n_neg = positive, total - positive
    have = [np.zeros(len(number), np.int64) for _ in (0, 1)]
    for label, d in docs:
        have[label][d] += 1
    ratio = log_count_ratio(have[1], have[0], n_pos, n_neg)
    names = list(number)
    usable = np.flatnonzero(have[0] + have[1] >= min_rows).tolist()
    weight = np.abs(ratio) * np.minimum(have[0] + have[1], 50)
    best = sorted(usable, key=lambda k: (-weight[k], names[k]))[:max_grams]
    place = np.full(len(number) + 1, -1, np.int64)
    place[best] = np.arange(len(best))
    scale = np.append(ratio[best], 1.0)  # the last is the intercept
    rows: list[np.ndarray] = []
    y = np.array([1 if label else -1 for label, _ in docs])
    for _, d in docs:
        rows.append(np.append(np.sort(place[d][place[d] >= 0]), len(best)).astype(np.int32))
    del docs
    back = np.arange(len(rows)) % 4 == 3  # held back for the sigmoid
    even = np.where(y > 0, cost * len(y) / (2 * n_pos), cost * len(y) / (2 * n_neg))
    if len(set(y[~back])) == 2 and len(set(y[back])) == 2:
        part = [rows[i] for i in np.flatnonzero(~back)]
        w = dual_coordinate_descent(part, scale, y[~back], even[~back])
        slope, shift = sigmoid_fit(np.array([w[rows[i]] @ scale[rows[i]] for i in np.flatnonzero(back)]), y[back])
    else:
        slope, shift = 1.0, 0.0
    w = dual_coordinate_descent(rows, scale, y, even)
    final = w * scale
    return Model({names[k]: float(final[i]) for i, k in enumerate(best) if final[i]}, float(final[-1]), slope, shift)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``; the model travels to the executors once."""
    rows = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(t.as_py() for t in b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def score_column(docs: DataFrame, model: Model):
    """A function from a text column of ``docs`` to its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(t if isinstance(t, str) else None for t in text))

    return score


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", allowed: Column | None = None, max_rows: int = 10_000) -> Model:
    """A model fitted on at most ``max_rows`` labelled rows; by default not on those whose crc32 is divisible by 5."""
    ok = remainder(F.col("doc_id"), 5) != 0 if allowed is None else allowed
    return fit(labelled_sample(docs, labels, label, ok, max_rows))
