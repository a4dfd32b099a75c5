"""Approximate nearest neighbours by a permutation index.

A vector is represented by all pivots in the order of their distance to it. It is posted to the inverted files of its ``posts``
nearest pivots, and nowhere else. A query reads the files of its own ``reads`` nearest pivots and no others. In each file the
entries are ranked by footrule distance to the query (the sum over the pivots of how far apart their places are); the
share ``share`` of them (``k`` + 1 at least, so that any file can answer) is ranked again by Euclidean distance in double precision.

A file is one unit of work, or several where it has more than ``LIST`` entries; a unit holds its entries and streams the queries
past them. What is moved is ``posts`` rows for each vector and, for each query, a row for every unit that it reads. Equal
vectors are one entry, with the ``k`` + 1 smallest of their ids; equal queries are asked once. The pivots are a bounded sample of the rows
(``pivots`` of them); every row is indexed. Recall depends on ``reads`` and ``share``: see the README for measurements.

Defined results: vectors that are null, zero, of a length other than the pivots' or with null or non-finite
components, and rows without an id, take no part; of rows that share an id the smallest vector counts; ties go to the
smaller id; queries with fewer candidates than ``k`` get them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import stored, tasks

#: Entries of a file that one unit holds.
LIST = 1024


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` different vectors, those first by a hash of their ids among 16 n rows; copies of one vector count once."""
    rows = vectors.orderBy(F.xxhash64(F.lit("pivot"), F.col("id")), "id").limit(16 * n).select("vector").toArrow()["vector"].combine_chunks()
    sizes = np.diff(rows.offsets.to_numpy())
    if not len(sizes):
        return np.zeros((0, 0))
    seen, times = np.unique(sizes, return_counts=True)
    common = int(seen[times.argmax()])
    flat, starts = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()[:-1][sizes == common]
    same = flat[starts[:, None] + np.arange(common)]
    first = np.sort(np.unique(same, axis=0, return_index=True)[1])
    return same[first[:n]]


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row, the pivots in the order of their distance; ties to the smaller number."""
    apart = (pivots**2).sum(1) - 2 * (x @ pivots.T)
    return np.argsort(apart, axis=1, kind="stable").astype(np.int16)


def places(orders: np.ndarray) -> np.ndarray:
    """For each row, the place of every pivot in its order."""
    out = np.empty_like(orders)
    np.put_along_axis(out, orders.astype(np.int64), np.arange(orders.shape[1], dtype=orders.dtype)[None], axis=1)
    return out


def footrule(entries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The footrule distance of a query's places to those of every entry."""
    return np.abs(entries - query).sum(1, dtype=np.int64)


def nearest(vectors: DataFrame, *, is_query: Column, k: int = 10, pivots: int = 512, posts: int = 5, reads: int = 96, share: float = 0.1) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of ``vectors(vec_id, embedding)`` to each row for which ``is_query`` holds."""
    if pivots > np.iinfo(np.int16).max:
        raise ValueError("pivots are numbered by 16 bits")
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("vector"), F.max("asks").alias("asks")).withColumnRenamed("vec_id", "id")
    rows = stored(rows, "vectors")
    points = choose_pivots(rows, pivots)
    size, n_pivots = points.shape[1], len(points)
    if not n_pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == size)
    # equal vectors are one class, named by its smallest id; of the other ids, those that an answer can hold
    first = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    classes = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.element_at("ids", 1)), "vector-classes")
    asking = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("vector").alias("q_vector"))
    sent = spark.sparkContext.broadcast(points)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            near = permutations(x, sent.value)[:, : max(posts, reads)].astype(np.int32)
            cols = [pa.array(list(near), pa.list_(pa.int32())), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays([b["cid"], b["ids"], b["asks"], *cols], ["cid", "ids", "asks", "near", "vector"])

    asked = asking.select("q_vector").distinct().withColumn("asks", F.lit(True))
    known = classes.join(asked, F.col("vector") == F.col("q_vector"), "left").select("cid", "ids", "vector", F.coalesce("asks", F.lit(False)).alias("asks"))
    indexed = stored(known.mapInArrow(index, "cid long, ids array<long>, asks boolean, near array<int>, vector binary"), "permutations")
    entries = indexed.select("cid", "vector", F.explode(F.slice("near", 1, posts)).alias("p"))
    # one row for each pivot, so as many at most: into how many units its file is cut
    cuts = F.broadcast(stored(entries.groupBy("p").agg(F.ceil(F.count("*") / LIST).cast("int").alias("units")), "files"))
    entries = entries.join(cuts, "p").select("p", F.pmod(F.xxhash64("cid"), "units").cast("int").alias("unit"), F.lit(0).alias("kind"), "cid", "vector")
    asks = indexed.filter("asks").select("cid", "vector", F.explode(F.slice("near", 1, reads)).alias("p")).join(cuts, "p")
    asks = asks.withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).select("p", "unit", F.lit(1).alias("kind"), "cid", "vector")
    met = entries.unionByName(asks).repartition(tasks(spark), "p", "unit").sortWithinPartitions("p", "unit", "kind", "cid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _files(batches, size, sent.value):
            yield from file(k, share)

    found = stored(met.mapInArrow(search, "q_cid long, cid long, score double").distinct(), "neighbours")
    place = Window.partitionBy("q_cid").orderBy("score", "cid")
    found = found.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= k + 1).select("q_cid", F.col("cid").alias("f_cid"), "score")
    # from classes to rows: at most k + 1 ids of each of k + 1 classes
    names = indexed.select(F.col("cid").alias("n_cid"), F.col("ids").alias("n_ids"))
    found = found.join(names, F.col("f_cid") == F.col("n_cid")).select("q_cid", "score", F.explode("n_ids").alias("vec_id"))
    asking = asking.join(classes.select("cid", "vector"), F.col("q_vector") == F.col("vector")).select("query_id", "cid")
    found = found.join(asking, F.col("q_cid") == F.col("cid")).filter(F.col("vec_id") != F.col("query_id"))
    place = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _File:
    """Entries of a unit, and some of the queries that read it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray, asks: list[tuple[int, bytes]], pivots: np.ndarray):
        self.ids, self.x, self.at, self.asks, self.pivots = ids, x, at, asks, pivots

    def __call__(self, k: int, share: float) -> Iterator[pa.RecordBatch]:
        q = np.frombuffer(b"".join(v for _, v in self.asks), np.float64).reshape(len(self.asks), -1)
        mine = places(permutations(q, self.pivots))
        n = min(len(self.ids), max(k + 1, math.ceil(share * len(self.ids))))
        asked, near, score = [], [], []
        for i, (cid, _) in enumerate(self.asks):
            cand = np.argpartition(footrule(self.at, mine[i]), n - 1)[:n] if n < len(self.ids) else np.arange(n)
            d = self.x[cand] - q[i]
            d = np.sqrt((d * d).sum(1))
            best = np.lexsort((self.ids[cand], d))[: k + 1]
            asked += [cid] * len(best)
            near.append(self.ids[cand[best]])
            score.append(d[best])
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(np.concatenate(near)), pa.array(np.concatenate(score))], ["q_cid", "cid", "score"])


def _files(batches: Iterator[pa.RecordBatch], size: int, pivots: np.ndarray) -> Iterator[_File]:
    """Rows sorted by unit, entries first; of a unit's queries, those of one batch at a time."""
    now, ids, vectors, held = None, [], [], None
    for b in batches:
        asks: list[tuple[int, bytes]] = []
        for p, unit, kind, cid, vector in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (p, unit) != now:
                if asks:
                    yield _File(*held, asks, pivots)
                now, ids, vectors, held, asks = (p, unit), [], [], None, []
            if kind == 0:
                ids.append(cid)
                vectors.append(vector)
                continue
            if held is None and ids:
                x = np.frombuffer(b"".join(vectors), np.float64).reshape(-1, size)
                held = np.array(ids, np.int64), x, places(permutations(x, pivots))
            if held is not None:
                asks.append((cid, vector))
        if asks:
            yield _File(*held, asks, pivots)
