"""How far the sources of a language are apart in their words, from dense matrices over blocks of terms.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. Each language keeps the terms that
``least`` of its documents have. A group is a (language, source); it and the whole language give a kept term the
probability, in integers of a billionth,

    p = 1 + floor(10^9 * (count + 5) / (N + 5 V))

Each task counts terms in hash tables that it empties when they are full, so that what is shuffled are sums by language, source
and term, however frequent a word is. Kept terms are dealt into blocks of about ``block`` terms by their hash. For each block
the counts of all of a language's groups become an int64 matrix of groups by terms; all pairs of groups are broadcast against each
other, a few rows of the matrix at a time, and give a partial matrix of absolute differences, and each group's ``top`` terms of the block.
Partial matrices are summed and the blocks' tops merged by Spark. Where a language has more than ``strip`` groups, a task
takes ``strip`` rows of the matrix of pairs, against all groups.

Defined results: null text, language and source are empty strings; a group without terms takes part with counts of 0; a
language without kept terms has all its pairs with value 0 and no terms; repeated rows are documents of their
own, as many times as they occur; ids and other columns are ignored; an empty table gives no rows. Counts of a term may reach 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import stored

SCALE, SMOOTH = 1_000_000_000, 5
#: Entries of a task's hash tables, after which they are emptied.
ENTRIES = 200_000
#: Numbers of a piece of the broadcast of pairs.
PIECE = 4_000_000
#: For each byte, itself where it is part of a term, in lower case, else a blank.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _flush(words: dict, docs: dict, rows: Counter) -> pa.RecordBatch:
    """Counts so far as rows; the empty term has a group's documents."""
    lang, source, term, n, found = [], [], [], [], []
    for key in rows:
        own, seen = words[key], docs[key]
        size = len(own) + 1
        lang += [key[0]] * size
        source += [key[1]] * size
        term += [b"", *own]
        n += [0, *own.values()]
        found += [rows[key], *(seen[t] for t in own)]
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(found, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, docs, rows = defaultdict(Counter), defaultdict(Counter), Counter()
    held = 0
    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"], strict=True):
            key = lang, source
            own = words[key]
            held -= len(own)
            found = text.as_py().translate(LETTERS).split()
            own.update(found)
            docs[key].update(set(found))
            rows[key] += 1
            held += len(own)
            if held > ENTRIES:
                yield _flush(words, docs, rows)
                words, docs, rows, held = defaultdict(Counter), defaultdict(Counter), Counter(), 0
    if rows:
        yield _flush(words, docs, rows)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, term, docs, counts`` with ``counts`` of ``source, n``: one row for each term of a language. The empty term has all its groups, with n = 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    # dealt by language and term once; both sums then stay where they are
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))


def probabilities(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), by long division in steps of three digits, as the product may not fit 64 bits."""
    rest, by = counts + SMOOTH, total + SMOOTH * terms
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return out + 1


def _tile(top: int, strip: int):
    """For a block of terms, partial sums of the pairs (part 0) and each group's best terms (part 1)."""

    def run(key: tuple[pa.Scalar, ...], terms: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("at")
        names, total, v = groups["source"].combine_chunks(), groups["total"].to_numpy(), groups["v"][0].as_py()
        lo = key[2].as_py() * strip
        hi = min(lo + strip, len(names))
        terms = terms.sort_by("term")
        counts = np.zeros((len(names), len(terms)), np.int64)
        lists = terms["counts"].combine_chunks()
        at = pc.index_in(lists.flatten().field("source"), value_set=names).to_numpy(zero_copy_only=False)
        counts[at, pc.list_parent_indices(lists).to_numpy()] = lists.flatten().field("n").to_numpy()
        p = probabilities(counts, total[:, None], v)
        q = probabilities(counts.sum(0), total.sum(), v)
        pairs = np.zeros((hi - lo, len(names)), np.int64)
        rows = max(1, PIECE // max(1, p.size))
        for i in range(lo, hi, rows):
            j = min(i + rows, hi)
            pairs[i - lo : j - lo] = np.abs(p[i:j, None, :] - p[None, :, :]).sum(2)
        a, b = np.nonzero(np.arange(lo, hi)[:, None] != np.arange(len(names))[None, :])
        owner, value = [a + lo], [pairs[a, b]]
        item = [names.cast(pa.binary()).take(pa.array(b))]
        for i in range(lo, hi):
            f = np.where(counts[i] > 0, p[i] - q, 0)
            best = np.argsort(-f, kind="stable")[:top]
            best = best[f[best] > 0]
            owner.append(np.full(len(best), i))
            value.append(f[best])
            item.append(terms["term"].combine_chunks().take(pa.array(best)))
        owner, value = np.concatenate(owner), np.concatenate(value)
        kind = np.repeat(np.array([0, 1], np.int32), [len(a), len(owner) - len(a)])
        lang = pa.array([key[0].as_py()] * len(owner), pa.string())
        return pa.table([lang, names.take(pa.array(owner)), pa.array(kind), pa.concat_arrays([x.cast(pa.binary()) for x in item]), pa.array(value, pa.int64())], ["lang", "source", "kind", "item", "value"])

    return run


def divergence(docs: DataFrame, *, least: int = 30, top: int = 50, block: int = 2048, strip: int = 256) -> DataFrame:
    """``lang, source, part, item, value, rank`` for the groups of ``docs(lang, source, text)``.

    Part ``pair``: every other source of the language, by the sum of |p - q| over all kept terms. Part ``term``: the ``top`` kept terms that the group has and
    that are likelier in it than in the language, by p - q.
    """
    counts = stored(term_counts(docs).filter((F.col("docs") >= least) | (F.length("term") == 0)), "term-counts")
    kept = counts.filter(F.length("term") > 0)
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = counts.filter(F.length("term") == 0).select("lang", F.size("counts").alias("sources"), F.explode("counts.source").alias("source"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    # names by their UTF-8 bytes are numbered within the language
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("v") / block)).cast("int"), "strips": F.ceil(F.col("sources") / strip).cast("int")})
    groups = stored(groups, "term-groups")
    strips = F.explode(F.sequence(F.lit(0), F.col("strips") - 1))
    dealt = groups.filter("at = 0").select("lang", "blocks", "strips")
    terms = kept.select("lang", "term", "counts").join(dealt, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("strip", strips)
    facing = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("strip", strips)
    terms = terms.select("lang", "block", "strip", "term", "counts")
    facing = facing.select("lang", "block", "strip", "source", "at", "total", "v")
    tiles = terms.groupBy("lang", "block", "strip").cogroup(facing.groupBy("lang", "block", "strip")).applyInArrow(_tile(top, strip), "lang string, source string, kind int, item binary, value long")
    tiles = stored(tiles, "term-tiles")
    pairs = tiles.filter("kind = 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    best = tiles.filter("kind = 1").withColumn("part", F.lit("term"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    columns = "lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank"
    return pairs.withColumn("rank", place).select(*columns).unionByName(best.withColumn("rank", place).filter(F.col("rank") <= top).select(*columns))
