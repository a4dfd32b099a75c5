"""Labelled rows for a classifier to learn from."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import stored


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int) -> DataFrame:
    """``text, label`` (0 or 1) and ``hash`` of at most ``rows`` labelled documents for which ``allowed`` holds, each different text once.

    Ids are chosen by their hash, the same at every run. Only the ids are sorted; the texts of those chosen are then
    fetched by a broadcast of at most ``rows`` ids. An id with both labels counts as 1; a text of several documents has the label that most
    of them have, 1 in a tie. ``hash`` is SHA-256 of the text in hex: it orders the rows and deals them into parts, whatever the order of ``docs``.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # the first `rows` ids by hash: each task keeps no more than that many
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id")), "doc_id").limit(rows).select(F.col("doc_id").alias("l_id"), "label")
    chosen = stored(chosen, "sample-ids")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    found = found.withColumn("hash", F.sha2("text", 256))
    return stored(found.groupBy("hash").agg(F.first("text").alias("text"), (F.avg("label") >= 0.5).cast("int").alias("label")), "sample")


def streamed(sample: DataFrame) -> Iterator[tuple[str, int, str]]:
    """Text, label and hash of each row in the order of the hashes; the driver holds one partition at a time."""
    for row in sample.orderBy("hash").select("text", "label", "hash").toLocalIterator():
        yield row["text"], row["label"], row["hash"]


def part_of(hashes: str, n: int, digit: int) -> int:
    """One of ``n`` parts, by eight hex digits of the hash from ``digit`` on."""
    return int(hashes[digit : digit + 8], 16) % n
