"""Hard negatives by a norm-bucketed search of inner products.

Components are scaled to integers, so every score is exact. Candidates are sorted by their norm, dealt into units by ranges of it, and within a
unit cut into buckets of ``BUCKET`` vectors. By the Cauchy-Schwarz inequality no vector of a bucket scores more than

    |anchor| * (largest norm of the bucket)

so a bucket is passed over where that is below what still counts: the lower limit of each of the anchor's windows, and the score of the last of the best found so
far (the running k-th score). It is used twice. Every anchor first asks the unit of largest norms, which gives it a running k-th score; then it is sent only
to the units that may beat it. In a unit the buckets are visited from large norms to small ones, each by the anchors that may still gain from it.

Positives are searched among the rows of the anchor's label, negatives among all; a positive's score gives a window of scores, and
an anchor brings all its (few) windows at once. Equal vectors of one label are one class with the smallest of its ids, as many as an answer can hold; anchors of
a class are one search. A unit's vectors are in memory once; anchors are streamed past them, a batch at a time.

Defined results: rows with a null id, label or vector, with null or non-finite components or none, take no part, nor do rows whose integer
squared norm is beyond 2^62, as their scores may not fit a long; rows meet only rows with as many components; of rows that share an id the one with the
smallest label and vector counts; ties go to the smaller id; a positive with a negative score has no window, one with score 0 only scores of 0; anchors without
positives or negatives give no rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import stored, tasks

#: Vectors of a bucket, and of a unit at least and at most.
BUCKET, LEAST_UNIT, MOST_UNIT = 256, 1024, 65_536
#: Units at most, as their bounds are broadcast; beyond, units get larger.
MOST_UNITS = 16_384
#: Anchors that are multiplied with a bucket at once.
BATCH = 256
#: Beyond this product of norms, scores are summed as Python's integers.
EXACT = float(1 << 52)


def scaled(vector: Column, by: float = 256.0) -> Column:
    """floor(by * x) of each component, as doubles that hold integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("double"))


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _classes(rows: DataFrame, held: int) -> DataFrame:
    """``label, vector, cid, ids, size, norm``: one row for each different vector of a label, with its ``held`` smallest ids."""
    first = Window.partitionBy("label", "vector").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= held)
    out = few.groupBy("label", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return out.select("label", "vector", F.element_at("ids", 1).alias("cid"), "ids", F.size("vector").alias("size"), F.sqrt(square).alias("norm"))


def _units(classes: DataFrame, n: int, *by: str) -> DataFrame:
    """Classes in units, ranges of ``by`` and falling norms; written, so that the ranges are settled."""
    spark = classes.sparkSession
    per = max(LEAST_UNIT, min(MOST_UNIT, -(-n // (4 * tasks(spark)))), -(-n // MOST_UNITS))
    dealt = classes.repartitionByRange(max(1, -(-n // per)), *by, F.col("norm").desc(), "cid")
    return stored(dealt.withColumn("unit", F.spark_partition_id()), "norm-units")


def _visits(asks: DataFrame, bounds: DataFrame) -> DataFrame:
    """The units to which an anchor is sent: all whose bound reaches its ``least`` score. Of ``bounds(unit, .., most, turn)``, by size and, if it is there, label."""
    on = asks["size"] == bounds["b_size"]
    if "b_label" in bounds.columns:
        on = on & (asks["label"] == bounds["b_label"])
    return asks.join(bounds, on & (F.coalesce("least", F.lit(float("-inf"))) <= asks["norm"] * F.col("most") * (1 + 1e-9)))


def _bounds(units: DataFrame, *by: str) -> DataFrame:
    """The largest norm of each unit (and label), and its place by that, 0 for the largest."""
    rows = units.groupBy("unit", *by).agg(F.max("norm").alias("most"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("most").desc(), "unit")) - 1
    return stored(rows.select("unit", *[F.col(c).alias(f"b_{c}") for c in by], "most", turn.alias("turn")), "norm-bounds")


FOUND = "q_cid long, q_label long, window long, f_cid long, f_label long, score long"


def _search(units: DataFrame, visits: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``FOUND`` rows: for each anchor sent to a unit and each of its windows, the unit's ``k`` best classes with that score and with its label, or another.

    ``visits`` has ``unit, label, cid, vector, norm, windows`` with ``windows`` of ``window, lo, hi, kth``.
    """
    blank = F.array().cast("array<struct<window:bigint,lo:bigint,hi:bigint,kth:bigint>>")
    entries = units.select("unit", F.lit(0).alias("kind"), "label", "cid", "vector", "norm", blank.alias("windows"))
    asks = visits.select("unit", F.lit(1).alias("kind"), "label", "cid", "vector", "norm", "windows")
    size = F.size("vector")
    met = entries.unionByName(asks).withColumn("size", size).repartition(tasks(units.sparkSession), "unit", "size").sortWithinPartitions("unit", "size", "kind", F.col("norm").desc(), "cid")
    met = met.select("unit", "size", "kind", "label", "cid", "vector", "norm", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, unit = None, [], None
        for b in batches:
            key = np.stack([b["unit"].to_numpy(), b["size"].to_numpy(), b["kind"].to_numpy()])
            starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            for lo, hi in zip(starts, np.r_[starts[1:], key.shape[1]], strict=True):
                piece, at = b.slice(lo, hi - lo), (key[0, lo], key[1, lo])
                if at != now:
                    now, parts, unit = at, [], None
                if key[2, lo] == 0:
                    parts.append(_Rows(piece, int(at[1])))
                elif parts or unit:
                    unit = unit or _Unit(parts)
                    parts = []
                    for i in range(0, hi - lo, BATCH):
                        yield unit.answers(piece.slice(i, BATCH), k, same_label)

    return met.mapInArrow(run, FOUND)


class _Rows:
    """Columns of a batch as arrays."""

    def __init__(self, b: pa.RecordBatch, size: int):
        self.cid, self.label, self.norm = b["cid"].to_numpy(), b["label"].to_numpy(), b["norm"].to_numpy()
        self.x = b["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class _Unit:
    """Vectors in buckets of falling norms; in a bucket in the order of their ids."""

    def __init__(self, parts: list[_Rows]):
        cid, label, norm, x = (np.concatenate([getattr(p, c) for p in parts]) for c in ("cid", "label", "norm", "x"))
        self.buckets = []
        for i in range(0, len(cid), BUCKET):
            at = i + np.argsort(cid[i : i + BUCKET], kind="stable")
            self.buckets.append((norm[i], cid[at], label[at], x[at]))

    def answers(self, b: pa.RecordBatch, k: int, same_label: bool) -> pa.RecordBatch:
        asks = _Rows(b, b["vector"].flatten().__len__() // max(1, b.num_rows))
        windows = b["windows"].to_pylist()
        # for each anchor and window the best so far: (-score, id, label), and the score to reach
        best: list[list[list[tuple[int, int, int]]]] = [[[] for _ in w] for w in windows]
        need = [[max(w["lo"], w["kth"]) for w in own] for own in windows]
        least = np.array([min(n, default=np.inf) for n in need], np.float64)
        for most, cid, label, x in self.buckets:
            active = np.flatnonzero(asks.norm * most * (1 + 1e-9) >= least)
            if not len(active):
                continue
            if asks.norm[active].max() * most < EXACT:
                scores = (asks.x[active] @ x.T).astype(np.int64)
            else:
                scores = np.array([[sum(int(u) * int(v) for u, v in zip(p, q, strict=True)) for q in x] for p in asks.x[active]], np.int64)
            fits = (label[None] == asks.label[active, None]) == same_label
            hit = fits & (scores >= least[active, None])
            for row, i in zip(np.flatnonzero(hit.any(1)), active[hit.any(1)], strict=True):
                at = np.flatnonzero(hit[row])
                s = scores[row, at]
                order = np.argsort(-s, kind="stable")
                at, s = at[order], -s[order]  # rising
                for j, w in enumerate(windows[i]):
                    lo, hi = np.searchsorted(s, -w["hi"]), np.searchsorted(s, -need[i][j], "right")
                    if lo >= hi:
                        continue
                    new = [(int(s[m]), int(cid[at[m]]), int(label[at[m]])) for m in range(lo, min(hi, lo + k))]
                    best[i][j] = sorted(best[i][j] + new)[:k]
                    if len(best[i][j]) == k:
                        need[i][j] = max(need[i][j], -best[i][j][-1][0])
                least[i] = min(need[i])
        rows = [(int(asks.cid[i]), int(asks.label[i]), w["window"], c, lab, -s) for i, own in enumerate(windows) for j, w in enumerate(own) for s, c, lab in best[i][j]]
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q_cid", "q_label", "window", "f_cid", "f_label", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("q_cid", "q_label", "window").orderBy(F.col("score").desc(), "f_cid", "f_label")
    return found.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k).drop("n")


def _best(units: DataFrame, bounds: DataFrame, asks: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The ``k`` best of all units for each anchor and window: first from the unit of largest norms, then from those that may have better ones."""
    own = F.aggregate("windows", F.lit(None).cast("long"), lambda s, w: F.least(s, F.greatest(w["lo"], w["kth"])))
    asks = asks.withColumn("least", own.cast("double"))
    early = stored(_first(_search(units, _visits(asks, bounds.filter("turn = 0")), k, same_label), k), "norm-first")
    # the score to beat in each window is the last of k found, else the window's own limit
    kth = early.groupBy("q_cid", "q_label", "window").agg(F.when(F.count("*") >= k, F.min("score")).alias("s")).filter("s IS NOT NULL")
    kth = kth.groupBy("q_cid", "q_label").agg(F.map_from_entries(F.collect_list(F.struct("window", "s"))).alias("found"))
    later = asks.join(kth, (F.col("cid") == F.col("q_cid")) & (F.col("label") == F.col("q_label")), "left").drop("q_cid", "q_label")
    raised = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), w["lo"].alias("lo"), w["hi"].alias("hi"), F.greatest(w["kth"], F.try_element_at("found", w["window"])).alias("kth")))
    later = later.withColumn("windows", raised).withColumn("least", own.cast("double"))
    late = _search(units, _visits(later, bounds.filter("turn > 0")), k, same_label)
    return _first(early.unionByName(late), k)


def hard_negatives(
    rows: DataFrame, *, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``rows(vec_id, label, embedding)``; ``is_anchor`` may refer to ``vec_id``.

    An anchor's positives are its best ``positives`` other rows of its label. The negatives of each are the best ``negatives`` rows of other labels
    with a score of ``low`` to ``high`` percent of the positive's.
    """
    spark = rows.sparkSession
    good = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    good = good.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), scaled(F.col("embedding"), scale).alias("vector"), is_anchor.alias("asks"))
    good = good.filter(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) <= float(1 << 62))
    good = good.groupBy("id").agg(F.min(F.struct("label", "vector", "asks")).alias("r")).select("id", "r.*")
    good = stored(good, "negative-rows")
    held = max(positives + 1, negatives)
    classes = stored(_classes(good, held), "negative-classes")
    n = classes.count()
    anchors = stored(good.filter("asks").join(classes.select("label", "vector", "cid"), ["label", "vector"]).select("id", "label", "cid"), "anchors")
    asks = classes.join(anchors.select("label", "cid").distinct(), ["label", "cid"], "left_semi").select("label", "cid", "vector", "size", "norm")
    window = lambda name, lo, hi: F.struct(name.alias("window"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), lo.cast("long").alias("kth"))
    names = classes.select(F.col("cid").alias("f_cid"), F.col("label").alias("f_label"), F.col("ids").alias("f_ids"))

    # positives: any score, own label
    units = _units(classes, n, "size", "label")
    limit = 1 << 62
    first = asks.withColumn("windows", F.array(window(F.lit(0).cast("long"), F.lit(-limit), F.lit(limit))))
    found = _best(units, _bounds(units, "size", "label"), first, positives + 1, True)
    found = found.join(names, ["f_cid", "f_label"]).select("q_cid", "q_label", "score", F.explode("f_ids").alias("positive_id"))
    mine = anchors.join(found, (F.col("cid") == F.col("q_cid")) & (F.col("label") == F.col("q_label"))).filter("positive_id <> id")
    place = Window.partitionBy("id").orderBy(F.col("score").desc(), "positive_id")
    mine = mine.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= positives)
    mine = stored(mine.select(F.col("id").alias("anchor_id"), "cid", "label", "positive_id", F.col("score").alias("positive_score")), "positives")

    # negatives: a window for each different score of a class's positives
    score = F.col("positive_score")
    spans = mine.filter("positive_score >= 0").select("cid", "label", "positive_score").distinct()
    # ceil(low / 100 * score) and floor(high / 100 * score), whose products may not fit a long
    lo = F.expr(f"{low} * (positive_score div 100) + ({low} * (positive_score % 100) + 99) div 100")
    hi = F.expr(f"{high} * (positive_score div 100) + {high} * (positive_score % 100) div 100")
    spans = spans.groupBy("cid", "label").agg(F.collect_list(window(score, lo, hi)).alias("windows"))
    units = _units(classes, n, "size")
    bounds = F.broadcast(_bounds(units, "size"))
    found = _best(units, bounds, asks.join(spans, ["cid", "label"]), negatives, False)
    found = found.join(names, ["f_cid", "f_label"]).select("q_cid", "q_label", "window", "score", F.explode("f_ids").alias("negative_id"))
    place = Window.partitionBy("q_cid", "q_label", "window").orderBy(F.col("score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= negatives)
    out = mine.join(found, (F.col("cid") == F.col("q_cid")) & (F.col("label") == F.col("q_label")) & (score == F.col("window")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
