"""A corpus that is changed page by page: snapshots named by a manifest, committed only if nobody else committed meanwhile.

A change is a folder of chunks, written first, and the list of pages it replaces. Manifest ``n`` names the folders of snapshot ``n`` in
order; a page's chunks are those of the last folder that has the page, so that a page that shrinks loses its old ones, and one that is removed has none. Only
one writer can create manifest ``n``: another one that wanted to reads that one and tries ``n + 1``. Readers of a snapshot aren't disturbed by later ones.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.store import acquire, hadoop, release

#: A chunk's key on its page.
KEY = ("url", "section_id", "chunk_position")
#: Seconds after which the lock of a writer that died may be taken, and between two tries.
STALE, LOOK = 60.0, 0.2


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all snapshots."""
    files, at = hadoop(spark, path)
    found = files.globStatus(at(f"{path}/manifest/*.json")) or []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)


def _folders(spark: SparkSession, path: str, version: int) -> list[str]:
    """The folders of a snapshot, oldest first; none for number 0."""
    if not version:
        return []
    text = spark.read.text(f"{path}/manifest/{version:09d}.json", wholetext=True).head()[0]
    return json.loads(text)["folders"]


def _commit(spark: SparkSession, path: str, version: int, folders: list[str]) -> bool:
    """Create manifest ``version``; False if someone else did or is about to. It is written beside and renamed, so that it is whole or not there."""
    files, at = hadoop(spark, path)
    lock, place, made = f"{path}/manifest.lock", at(f"{path}/manifest/{version:09d}.json"), at(f"{path}/manifest/.{uuid.uuid4().hex}")
    if not acquire(spark, lock, STALE):
        time.sleep(LOOK)
        return False
    try:
        if files.exists(place):
            return False
        out = files.create(made, True)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        return files.rename(made, place)
    finally:
        release(spark, lock)


def upsert(chunks: DataFrame, path: str, *, removed: DataFrame | None = None, page: str = "file", tries: int = 100) -> int:
    """Replace all chunks of the pages in ``chunks``, and remove the pages of ``removed(<page>)``; the number of the snapshot made."""
    spark = chunks.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    chunks.dropDuplicates([c for c in (page, *KEY) if c in chunks.columns]).write.parquet(f"{path}/{folder}/chunks")
    pages = spark.read.parquet(f"{path}/{folder}/chunks").select(page)
    pages = pages if removed is None else pages.unionByName(removed.select(page))
    pages.distinct().write.parquet(f"{path}/{folder}/pages")
    for _ in range(tries):
        last = max(versions(spark, path), default=0)
        if _commit(spark, path, last + 1, [*_folders(spark, path, last), folder]):
            return last + 1
    raise RuntimeError(f"{path}: others committed {tries} times meanwhile")


def read(spark: SparkSession, path: str, version: int | None = None, *, page: str = "file") -> DataFrame | None:
    """The chunks of a snapshot, by default the last; None before the first.

    One union of the folders' pages, with the number of the last folder for each, decides which folder's chunks count.
    """
    version = max(versions(spark, path), default=0) if version is None else version
    folders = _folders(spark, path, version)
    if not folders:
        return None
    number = lambda name, i: spark.read.parquet(f"{path}/{folders[i]}/{name}").withColumn("__folder", F.lit(i))
    pages, rows = number("pages", 0), number("chunks", 0)
    for i in range(1, len(folders)):
        pages, rows = pages.unionByName(number("pages", i)), rows.unionByName(number("chunks", i), allowMissingColumns=True)
    if len(folders) == 1:
        return rows.drop("__folder")
    last = pages.groupBy(F.col(page).alias("__page")).agg(F.max("__folder").alias("__last"))
    return rows.join(last, F.col(page).eqNullSafe(F.col("__page")) & (F.col("__folder") == F.col("__last"))).drop("__page", "__last", "__folder")


def compact(spark: SparkSession, path: str, *, page: str = "file") -> int:
    """A snapshot of one folder with the same chunks; the number. If others commit meanwhile, it fails and changes nothing."""
    last = max(versions(spark, path), default=0)
    rows = read(spark, path, last, page=page)
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}/chunks")
    spark.read.parquet(f"{path}/{folder}/chunks").select(page).distinct().write.parquet(f"{path}/{folder}/pages")
    if not _commit(spark, path, last + 1, [folder]):
        raise RuntimeError(f"{path}: changed meanwhile")
    return last + 1
