"""Line deduplication by range-partitioned line hashes. DataFrame operations only.

Every line becomes a row (128-bit hash of its key, document, position). The rows are
dealt out by ranges of (hash, document) and sorted by hash, document and position, so a
line that is in a third of all documents is cut into many ranges, while the
lines of one document with one key stay together. One streaming pass over a range
marks the first occurrence in each document; counts and first occurrences of a key
are added up in each range before the partial rows meet. The keys that go are
joined back, and each document that loses a line gets a bitmap (words of 64 lines,
only those in which a line goes). No text is moved to make the bitmaps. To apply them, few
bitmaps (``BROADCAST_BITS``) are broadcast to the texts; more of them meet the texts by a shuffle.

Defined results: null or empty text is one empty line; a key of fewer than
``min_chars`` code points never goes; documents are told apart by doc_id and text, so
rows that repeat entirely count as one document and share its bitmap; an empty
table gives no rows; other columns pass through :func:`apply_bitmaps` unread, whatever
their names, but for ``kept_text``, ``n_lines`` and ``n_dropped``, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import stored, tasks
from quarry.llm.text import SPACES

#: Up to so many keys that go, of 16 bytes each, are broadcast; beyond, they meet their lines by shuffle.
BROADCAST_KEYS = 100_000
#: Keys found in more lines than this are broadcast all the same: there is at most one for so many lines.
HOT_KEY = 200_000
#: Up to so many bitmaps are broadcast, which have so many words of 16 bytes in all at most.
BROADCAST_BITS, BROADCAST_WORDS = 200_000, 500_000
RESULTS = ("kept_text", "n_lines", "n_dropped")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(SPACES))
    # lower() is several times as fast as translate(), and the same where all characters are ASCII
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Bitmaps of the lines that go, for the documents of ``docs(doc_id, text)`` that lose any.

    A key found in at least ``min_docs`` documents loses all its lines or, with ``keep_first``,
    all but the first of its smallest document. Returns ``b_doc, b_hash, bits``: ``bits`` is a
    sorted array of (block, word), and bit b of the word of block k is set if line 64 k + b goes.
    """
    spark = docs.sparkSession
    lines = (
        docs.select("doc_id", text_hash(F.col("text")).alias("hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"), "doc_id", "hash", "pos")
    )
    lines = stored(lines, "lines")  # or the range bounds would be sampled from the texts a second time
    by_doc = Window.partitionBy("h1", "h2", "doc_id", "hash").orderBy("pos")
    ranged = lines.repartitionByRange(tasks(spark), "h1", "h2", "doc_id", "hash").withColumn("opens", (F.row_number().over(by_doc) == 1).cast("long"))
    ranged = stored(ranged, "line-ranges")
    keys = ranged.groupBy("h1", "h2").agg(F.sum("opens").alias("n"), F.min(F.struct("doc_id", "hash", "pos")).alias("first"))
    gone = stored(keys.filter(F.col("n") >= min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first", "n"), "line-keys")
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    n_gone, n_lines = gone.agg(F.count("*"), F.sum("n")).head()
    if n_gone <= BROADCAST_KEYS:
        out = ranged.join(F.broadcast(gone), same)
    else:
        # a key with more lines than `hot` is one of BROADCAST_KEYS at most
        hot = max(HOT_KEY, -(-n_lines // BROADCAST_KEYS))
        often, rest = gone.filter(F.col("n") > hot), gone.filter(F.col("n") <= hot)
        out = ranged.join(F.broadcast(often), same)
        out = out.unionByName(ranged.join(F.broadcast(often.select("k1", "k2")), same, "left_anti").join(rest, same))
    if keep_first:
        out = out.filter(~F.struct("doc_id", "hash", "pos").eqNullSafe(F.col("first")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(64)))
    words = out.groupBy("doc_id", "hash", F.floor(F.col("pos") / 64).cast("int").alias("block")).agg(F.bit_or(bit).alias("word"))
    return words.groupBy(F.col("doc_id").alias("b_doc"), F.col("hash").alias("b_hash")).agg(F.sort_array(F.collect_list(F.struct("block", "word"))).alias("bits"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept_text`` (the lines that stay, joined by a line feed), ``n_lines`` and ``n_dropped``."""
    bitmaps = stored(bitmaps, "bitmaps")
    n, words = bitmaps.agg(F.count("*"), F.coalesce(F.sum(F.size("bits")), F.lit(0))).head()
    few = n <= BROADCAST_BITS and words <= BROADCAST_WORDS
    names = [c for c in docs.columns if c not in RESULTS]
    # the row's own columns are one struct, so that no name of theirs can clash with ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text, doc = F.col("row")["text"], F.col("row")["doc_id"]
    rows = rows.withColumn("hash", text_hash(text))
    found = rows.join(F.broadcast(bitmaps) if few else bitmaps, doc.eqNullSafe(F.col("b_doc")) & (F.col("hash") == F.col("b_hash")), "left")
    lines = lines_of(text)
    # a dense array of words, so that each line's bit is found at once
    blocks = F.map_from_entries(F.col("bits"))
    dense = F.transform(F.sequence(F.lit(0), F.element_at(F.col("bits"), -1)["block"]), lambda k: F.coalesce(blocks[k], F.lit(0).cast("long")))
    found = found.withColumn("words", F.when(F.col("bits").isNotNull(), dense))

    def stays(_: Column, i: Column) -> Column:
        word = F.coalesce(F.get(F.col("words"), F.call_function("shiftright", i, F.lit(6))), F.lit(0).cast("long"))
        return F.call_function("shiftright", word, i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 0

    kept = F.when(F.col("bits").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    dropped = F.coalesce(F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["word"])), F.lit(0).cast("long"))
    found = found.withColumn("out", F.struct(kept.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), dropped.alias("n_dropped")))
    return found.select(*[F.col("row")[c].alias(c) for c in names], *[F.col("out")[c].alias(c) for c in RESULTS])
