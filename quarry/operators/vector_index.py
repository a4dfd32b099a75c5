"""A stored vector index: vectors in coarse cells, which are partitions of a table; a search reads the cells nearest to its questions.

Cell centres are fitted on a bounded sample of the vectors (``SAMPLE`` for each cell, the first by a hash of their ids) by a few rounds of spherical k-means. Every
vector is then put into the cell of its nearest centre, so none is missing; a search of all cells is exact, one of fewer cells isn't.
Vectors stay where they are: a task reads files of the cells that are asked for, multiplies each cell with the questions that ask for it, and keeps
the ``k`` best of each question over all that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import BLOCK, TOGETHER, Best, gathered, lots, ranked, units
from quarry.sources.store import tasks

#: Vectors that the centres are fitted on, for each cell, and rounds of fitting.
SAMPLE, ROUNDS = 64, 8


@dataclass(frozen=True)
class VectorIndex:
    """``rows(ord, embedding, ..., cell)`` and the cells' centres, of length 1."""

    rows: DataFrame
    centres: np.ndarray


def fitted(vectors: DataFrame, cells: int) -> np.ndarray:
    """Centres of at most ``cells`` cells, from a sample of ``SAMPLE * cells`` vectors."""
    sample = vectors.orderBy(F.xxhash64(F.lit("cells"), F.col("ord")), "ord").limit(SAMPLE * cells).select("embedding").toArrow()["embedding"].to_pylist()
    width = max(map(len, sample), default=0)
    x = units(sample, width)
    x = x[np.isfinite(x).all(1)] if width else x
    _, first = np.unique(x.round(12), axis=0, return_index=True)
    centres = x[np.sort(first)[:cells]]
    for _ in range(ROUNDS if len(centres) else 0):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def write_index(vectors: DataFrame, path: str, *, cells: int = 64, keep: tuple[str, ...] = ()) -> None:
    """Index ``vectors(ord, embedding, <keep>)``, in place of what is at ``path``. Vectors that are null, zero or of another length than most aren't found by any search and left out."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("embedding").isNotNull() & F.col("ord").isNotNull()).select(F.col("ord").cast("long").alias("ord"), "embedding", *keep)
    centres = fitted(rows, cells)
    sent = spark.sparkContext.broadcast(centres)  # `cells` vectors
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                if not len(sent.value):
                    continue
                near = units(b["embedding"].to_pylist(), sent.value.shape[1]) @ sent.value.T
                good = np.isfinite(near).all(1)
                b = b.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near[good].argmax(1), pa.int32())], [*names, "cell"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(run, f"{kinds}, cell int")
    n = tasks(spark)
    # a large cell is several files
    dealt = dealt.repartition(n, "cell", F.pmod(F.xxhash64("ord"), F.lit(-(-n // cells)))).sortWithinPartitions("cell", "ord")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    spark.createDataFrame([(f"{kinds}, cell int",)], "kinds string").write.mode("overwrite").parquet(f"{path}/about")


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index at ``path``."""
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    kinds = spark.read.parquet(f"{path}/about").head()["kinds"]
    return VectorIndex(spark.read.schema(kinds).parquet(f"{path}/rows"), np.array([r["centre"] for r in found], np.float64))


def search(index: VectorIndex, questions: DataFrame, k: int, *, probes: int | None = None, allowed: Column | None = None) -> DataFrame:
    """``query_id, rank, ord, score``: nearest by cosine to ``questions(query_id, q_vec)`` in the ``probes`` cells nearest to each, or in all.

    ``allowed`` is a filter on the index's columns, which the scan gets.
    """
    asked = questions.filter(F.col("q_vec").isNotNull()).select("query_id", F.col("q_vec").cast("array<double>").alias("q"))
    kind = asked.schema["query_id"].dataType.simpleString()
    side = index.rows if allowed is None else index.rows.filter(allowed)
    found = None
    for part in lots(asked):
        names, q = gathered(part)
        if len(index.centres) and len(q) and q.shape[1] == index.centres.shape[1]:
            near = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, : probes or len(index.centres)]
        else:
            near = np.zeros((len(q), 0), np.int64)
        cells = sorted(set(near.ravel().tolist()))
        # cells are folders: those that no question asks for aren't read
        rows = side.filter(F.col("cell").isin(cells)).select("cell", "ord", F.col("embedding").cast("array<double>").alias("v"))
        one = rows.mapInArrow(_cells(index.rows.sparkSession, names, q, near, k), f"query_id {kind}, ord long, score double")
        found = one if found is None else found.unionByName(one)
    return ranked(found, k)


def _cells(spark: SparkSession, names: pa.Array, q: np.ndarray, near: np.ndarray, k: int):
    """For Arrow batches of vectors with their cells, the ``k`` best of a task for each question that asks for the cell."""
    sent = spark.sparkContext.broadcast((names, q, {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, asks = sent.value
        lows = range(0, len(q), TOGETHER)
        best = [Best(len(q[lo : lo + TOGETHER]), k) for lo in lows]
        for whole in batches:
            for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                cell, ords = b["cell"].to_numpy(zero_copy_only=False), b["ord"].to_numpy(zero_copy_only=False)
                v = units(b["v"].to_pylist(), q.shape[1])
                for c in np.unique(cell):
                    at, rows = asks[int(c)], cell == c
                    for lo, own in zip(lows, best, strict=True):
                        mine = at[np.searchsorted(at, lo) : np.searchsorted(at, lo + TOGETHER)]
                        if len(mine):
                            worst = -np.round(q[mine] @ v[rows].T, 9)
                            worst[np.isnan(worst)] = np.inf
                            own.add(mine - lo, worst, ords[rows])
        for lo, own in zip(lows, best, strict=True):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own.q + lo)), pa.array(own.ord), pa.array(-own.worst)], ["query_id", "ord", "score"])

    return run
