"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text: how dense words of a lexicon are (a short public list, and words and
word beginnings that the labelled rows show to be toxic), how near they are to words
for the person spoken to, capitals, punctuation, and how much is obfuscated. Trees with logistic
loss are boosted over 32 quantile bins of each feature; predictions for rows left out are made
monotone against the labels (pool adjacent violators) to give the final score.

The learned lexicon of a row's features never comes from that row: the sample is split in two by the texts' hashes, and each half
is described by the other's lexicon. At most ``max_rows`` labelled rows are used, of those with equal text one. Words are counted and features
made on the executors; the driver gets the words of the lexicon and the rows' features, not their texts, and fits the trees.

Defined results: null text is the empty text and gets the score of its features (no words, no hits); with no
labelled rows, or rows of one label only, every score is that label's share (0.5 without rows); rows that repeat get
the same score; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.sample import labelled_sample, part_of, remainder

#: Insults that any list of them has.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown imbecile "
    "dumbass asshole bastard bitch bullshit crap damn freak hate jerk lunatic psycho retard shut slut ugly vermin "
    "idiota estúpido estúpida imbécil basura asqueroso inútil crétin idiote ordure connard dégoûtant "
    "dumm dummkopf trottel abschaum widerlich versager arschloch".split()
)
#: Words for the person spoken to.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[^\W\d_][\d@$!|*]+[^\W\d_]")
ODD_WORD = re.compile(r"[^\s]*[^\W\d_][\d@$!|*]+[^\W\d_][^\s]*")
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\S)")
STRETCH = re.compile(r"([^\W\d_])\1\1")
MARKS = re.compile(r"[!?]{2,}")
#: Lengths of the beginnings of words that may be learned.
STEMS = (3, 4, 5, 6, 7, 8)


@dataclass
class Lexicon:
    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()


def tokens(text: str) -> set[str]:
    """The words of a text, and their beginnings with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def telling(toxic: Column, other: Column, n_toxic: int, n_other: int, min_rows: int = 5) -> Column:
    """Whether toxic texts have a token and others hardly ever: a rate ten times that among others, with room for chance."""
    return (toxic >= min_rows) & ((toxic - F.sqrt(toxic)) / max(1, n_toxic) > 10 * (other + 1) / (n_other + 1))


def lexicon_of(kept: Iterable[str]) -> Lexicon:
    kept = set(kept)
    stems = {w[:-1] for w in kept if w[-1] == "*"}
    return Lexicon(frozenset(w for w in kept if w[-1] != "*"), frozenset(s for s in stems if not any(s[:k] in stems for k in STEMS if k < len(s))))


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """The lexicons of each half of ``sample(text, label, hash)`` and of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter[tuple[str, int]] = Counter()
            for text, label, h in zip(b["text"].to_pylist(), b["label"].to_pylist(), b["hash"].to_pylist(), strict=True):
                cell = 2 * part_of(h, 2, 0) + label
                count.update((w, cell) for w in tokens(text))
            rows = list(count.items())
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                cols = [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([n for _, n in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["token", "cell", "n"])

    half = F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), F.lit(2))
    size = {r["cell"]: r["n"] for r in sample.groupBy((2 * half + F.col("label")).cast("int").alias("cell")).agg(F.count("*").alias("n")).collect()}
    of = lambda cells: F.coalesce(F.sum(F.when(F.col("cell").isin(cells), F.col("n"))), F.lit(0))
    counted = sample.select("text", "label", "hash").mapInArrow(run, "token string, cell int, n long")
    parts = (([1], [0]), ([3], [2]), ([1, 3], [0, 2]))
    counted = counted.groupBy("token").agg(*[of(cells).alias(f"{kind}{i}") for i, part in enumerate(parts) for kind, cells in zip("to", part, strict=True)])
    tell = [telling(F.col(f"t{i}"), F.col(f"o{i}"), sum(size.get(c, 0) for c in t), sum(size.get(c, 0) for c in o)) for i, (t, o) in enumerate(parts)]
    rows = counted.select("token", *[t.alias(f"k{i}") for i, t in enumerate(tell)]).filter("k0 or k1 or k2").collect()
    return [lexicon_of(r["token"] for r in rows if r[f"k{i}"]) for i in range(3)]


NAMES = ("words", "listed", "listed_rate", "learned", "learned_rate", "learned_distinct", "stem", "stem_rate", "stem_distinct", "hits", "hit_rate", "near_you", "you_rate",
         "capitals", "shouted", "exclaims", "asks", "mark_runs", "punctuation", "odd_rate", "odd_hits", "spaced", "stretched", "mean_length")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The numbers of ``NAMES``."""
    low = text.lower()
    words = WORD.findall(low)
    n, size = max(1, len(words)), max(1, len(text))
    distinct = set(words)
    listed, learned = distinct & INSULTS, distinct & lexicon.words
    stems = {w for w in distinct if any(w[:k] in lexicon.stems for k in STEMS)} if lexicon.stems else set()
    bad = listed | learned | stems
    a = b = c = hits = near = you = 0
    if bad or distinct & SECOND:
        spots, persons = [], []
        for i, w in enumerate(words):
            if w in bad:
                spots.append(i)
                a, b, c = a + (w in listed), b + (w in learned), c + (w in stems)
            elif w in SECOND:
                persons.append(i)
        hits, you = len(spots), len(persons)
        if spots and persons:
            p, s = np.array(persons), np.array(spots)
            k = np.searchsorted(p, s)
            left, right = np.where(k > 0, s - p[np.maximum(k - 1, 0)], 99), np.where(k < len(p), p[np.minimum(k, len(p) - 1)] - s, 99)
            near = int((np.minimum(left, right) <= 5).sum())
    odd = ODD_WORD.findall(low) if ODD.search(low) else []
    odd_hits = sum(bool({(x := WORD.findall(w.translate(LEET)) or [""])[0], max(x, key=len)} & (INSULTS | lexicon.words)) for w in odd)
    spaced = SPACED.findall(low)
    upper = sum(map(str.isupper, text)) if text != low else 0
    return [
        math.log1p(len(words)), math.log1p(a), 1000 * a / n, math.log1p(b), 1000 * b / n, len(learned), math.log1p(c), 1000 * c / n, len(stems), math.log1p(hits), 1000 * hits / n,
        1000 * near / n, 1000 * you / n, upper / size, sum(len(w) > 2 for w in re.findall(r"\b[A-ZÀ-ÖØ-Þ]+\b", text)) / n if upper else 0.0, 1000 * text.count("!") / size, 1000 * text.count("?") / size,
        1000 * len(MARKS.findall(text)) / n, len(re.findall(r"[^\w\s]", text)) / size, 1000 * len(odd) / n, odd_hits, 1000 * len(spaced) / n, 1000 * len(STRETCH.findall(low)) / n, size / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees of fixed depth: the feature and the threshold of each inner node, the value of each leaf."""

    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Fit trees with logistic loss, each by the best split of binned features, level by level."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # rare features have all their quantiles at one value; the middle of what lies above is a cut too
    cuts = [np.unique(np.append(c, [np.median(col[col > c[-1]])] if (col > c[-1]).any() else [])) for c, col in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, base=float(np.log(share / (1 - share))))
    margin, width = np.full(len(y), model.base), bins + 2
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node, inner = np.zeros(len(y), np.int64), 2**depth - 1
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            local = node - first
            best = np.full(k, 1e-9)
            split = np.full(k, -1)
            for j, c in enumerate(cuts):
                at = local * width + binned[:, j]
                sg, sh = (np.bincount(at, v, k * width).reshape(k, width).cumsum(1) for v in (g, h))
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                gain = gain[:, : len(c)]
                top = gain.argmax(1)
                value = gain[np.arange(k), top]
                better = value > best
                best = np.where(better, value, best)
                split[better] = top[better]
                feature[first : first + k][better] = j
                threshold[first : first + k][better] = c[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
    return model


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the middle of each block of margins, and its smoothed share of labels."""
    values, place = np.unique(m, return_inverse=True)
    s, n = np.bincount(place, y), np.bincount(place)
    blocks = [[a, a, float(b), float(c)] for a, b, c in zip(values, s, n, strict=True)]
    out: list[list[float]] = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            lo, hi = out[-2], out.pop()
            lo[1], lo[2], lo[3] = hi[1], lo[2] + hi[2], lo[3] + hi[3]
    # both ends of a block, so that the steps are kept and only gaps are bridged
    x = np.array([e for b in out for e in (b[0], b[1])])
    p = np.array([(b[2] + 0.05) / (b[3] + 0.1) for b in out for _ in range(2)])
    return x, np.maximum.accumulate(p)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    x: np.ndarray
    p: np.ndarray
    flat: float = 0.5

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        rows = [features(t or "", self.lexicon) if self.trees else [0.0] for t in texts]
        if not self.trees or not rows:
            return np.full(len(rows), self.flat)
        m = self.trees.margin(np.array(rows, np.float64))
        # the margin orders texts that the calibration holds for equal
        return np.clip(np.interp(m, self.x, self.p) * 0.999 + 0.001 / (1 + np.exp(-np.clip(m, -35, 35))), 0, 1)


def fit(sample: DataFrame) -> Model:
    """Fit on ``sample(text, label, hash)``."""
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).head()
    if n < 8 or positive < 4 or n - positive < 4:
        return Model(Lexicon(), None, np.zeros(0), np.zeros(0), positive / n if n else 0.5)
    first, second, whole = learn_lexicons(sample)
    other = [second, first]  # each half is described by what the other shows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, other[part_of(h, 2, 0)]) for t, h in zip(b["text"].to_pylist(), b["hash"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["hash"], b["label"], pa.array(rows, pa.list_(pa.float64()))], ["hash", "label", "x"])

    rows = sample.select("text", "label", "hash").mapInArrow(run, "hash string, label int, x array<double>").toArrow().sort_by("hash")
    x = np.array(rows["x"].to_pylist(), np.float64)
    y = rows["label"].to_numpy().astype(np.float64)
    fold = np.array([part_of(h, 3, 8) for h in rows["hash"].to_pylist()])
    margins = np.zeros(len(y))
    for f in range(3):
        if (fold == f).any() and (fold != f).any():
            margins[fold == f] = boost(x[fold != f], y[fold != f]).margin(x[fold == f])
    px, pp = isotonic(margins, y)
    return Model(whole, boost(x, y), px, pp)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text)``; the model travels to the executors once."""
    rows = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(t.as_py() for t in b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", allowed: Column | None = None, max_rows: int = 10_000) -> Model:
    """A model fitted on at most ``max_rows`` labelled rows; by default not on those whose crc32 modulo 3 is 1."""
    ok = remainder(F.col("doc_id"), 3) != 1 if allowed is None else allowed
    return fit(labelled_sample(docs, labels, label, ok, max_rows))
