"""Document fingerprints: quartile bucket digests of byte triplets.

Triplets of bytes (places i, i + 5 and i + 11, the text taken as a ring) are hashed into 1024 buckets
and counted. A bucket's code is how many of the counts' three quartiles it exceeds, 0 to 3; the codes and
the logarithm of the length, in hex, are the digest. The difference of two digests is the sum of the codes'
differences and a bounded share for the length; their likeness is 1 minus the difference over the largest possible.
Triplets with gaps tell texts of one language apart better than neighbours do, as those mostly show the language's syllables.
With 1024 buckets a text of fewer than some 256 bytes leaves most buckets empty: all its quartiles are 0, its codes are 0 and 3 only, and its
digest is a map of the triplets that it has.

Defined results: null text is the empty text, whose digest has length 0 and codes 0; equal texts have equal digests;
an empty table gives no rows; other columns are ignored, whatever their names. In :func:`with_next` the next document is
that of the next row by doc_id (a null id first), then by a hash of the text; after the last comes the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import tasks

BUCKETS, GAPS = 1024, (5, 11)
#: What a step of the length's logarithm, and the length in all, add to the difference.
STEP, MOST = 8, 512
LARGEST = 3 * BUCKETS + MOST
ROWS, BYTES = 1024, 1 << 22


def _codes(texts: list[bytes]) -> np.ndarray:
    """The codes of each text, one row each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ring = GAPS[1]
    padded = b"".join(t + (t * (ring // len(t) + 1))[:ring] if t else b"" for t in texts)
    a = np.frombuffer(padded, np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes + ring * (sizes > 0))[:-1]])
    at = np.arange(len(owner), dtype=np.int64) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    x = a[at] * np.uint32(0x9E3779B1) + a[at + GAPS[0]] * np.uint32(0x85EBCA77) + a[at + GAPS[1]] * np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    x >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    counts = np.bincount(owner * BUCKETS + x, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
    places = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    quartiles = np.partition(counts, places, axis=1)[:, places]
    return sum((counts > quartiles[:, i : i + 1]).astype(np.uint8) for i in range(3))


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes (one row for each text) and the lengths' logarithms, in steps of an eighth."""
    codes, i = [np.zeros((0, BUCKETS), np.uint8)], 0
    while i < len(texts):
        k, size = i, 0
        while k < len(texts) and k - i < ROWS and (k == i or size + len(texts[k]) <= BYTES):
            size += len(texts[k])
            k += 1
        codes.append(_codes(texts[i:k]))
        i = k
    return np.concatenate(codes), np.rint(8 * np.log1p([len(t) for t in texts])).astype(np.int64)


def written(codes: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Two hex digits of the length, then two bits a bucket."""
    packed = codes[:, ::4] << 6 | codes[:, 1::4] << 4 | codes[:, 2::4] << 2 | codes[:, 3::4]
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(lengths.tolist(), packed, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for digests as different as can be."""
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(1, dtype=np.int64)
    return 1 - (apart + np.minimum(MOST, STEP * np.abs(la - lb))) / LARGEST


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for each row of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = written(*digests([(t or "").encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Digests of each row's text and of its edit, whose second half is the beginning of the next row's text.

    Rows are cut by doc_id into ranges between ids that a small sample shows to be there; the first rows of
    a range go to the range before, too, so that one pass in order sees each row with its next.
    The texts are shuffled once.
    """
    spark = docs.sparkSession
    n_ranges = 4 * tasks(spark)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    n, least = rows.agg(F.count("*"), F.min("key")).head()
    # at most some 20 ids for each range, wherever the ranges' ends then fall
    shown = [r[0] for r in rows.select("key").sample(fraction=min(1.0, 20 * n_ranges / max(1, n)), seed=1).collect()]
    bounds = np.unique(np.array(sorted(shown)[:: max(1, len(shown) // n_ranges)], np.int64))
    bounds = bounds[bounds > (least if least is not None else 0)]
    sent = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, key.to_numpy(), "right").astype(np.int32))

    @F.pandas_udf("boolean")
    def opens(key: pd.Series) -> pd.Series:
        b, k = sent.value, key.to_numpy()
        at = np.searchsorted(b, k, "left")
        return pd.Series((k == least) | ((at < len(b)) & (b[np.minimum(at, max(0, len(b) - 1))] == k) if len(b) else k == least))

    mine = F.struct(F.col("part"), F.lit(0).alias("tail"))
    before = F.struct(F.pmod(F.col("part") - 1, F.lit(len(bounds) + 1)).alias("part"), F.lit(1).alias("tail"))
    placed = rows.withColumn("part", range_of("key")).withColumn("opens", opens("key"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("opens"), F.array(mine, before)).otherwise(F.array(mine))))
    placed = placed.select("at.part", "at.tail", "key", "doc_id", "text")
    placed = placed.repartition(tasks(spark), "part").sortWithinPartitions("part", "tail", "key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return placed.select("part", "tail", "doc_id", "text").mapInArrow(
        _edited, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the one after it in its range; the last of a batch waits for the next batch."""
    held: tuple | None = None
    closed = -1  # the range whose last row has met its next
    kind = None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for i in range(0, batch.num_rows, ROWS):
            b = batch.slice(i, ROWS)
            here: list[tuple] = [held] if held else []
            for row in zip(*(b[c].to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
                if row[1] and row[0] == closed:
                    continue  # one tail is enough
                if row[1]:
                    closed = row[0]
                here.append(row)
            held = here[-1] if here and not here[-1][1] else None
            if len(here) > 1:
                yield _pairs(here, kind)
    assert held is None, "a range ends without the row after it"


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    text = [r[3] or "" for r in rows]
    pairs = [i for i in range(len(rows) - 1) if not rows[i][1]]
    raw = [t.encode("utf-8", "surrogatepass") for t in text]
    edit = [(text[i][: len(text[i]) - len(text[i]) // 2] + text[i + 1][: len(text[i]) // 2]).encode("utf-8", "surrogatepass") for i in pairs]
    codes, lengths = digests(raw)
    e_codes, e_lengths = digests(edit)
    own, after = np.array(pairs, np.int64), np.array(pairs, np.int64) + 1
    made = written(codes, lengths)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in pairs], kind),
            pa.array([len(text[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edit], pa.string()),
            pa.array([made[i] for i in pairs], pa.string()),
            pa.array(written(e_codes, e_lengths), pa.string()),
            pa.array(likeness(codes[own], e_codes, lengths[own], e_lengths)),
            pa.array(likeness(codes[own], codes[after], lengths[own], lengths[after])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
