"""A stored inverted index: postings are written once, questions read only what they need of them.

Rows of the corpus are cut into ranges of ``width`` numbers. The postings of a term in a range are one block: the rows' numbers, how often the term is in
them and how long they are, with the block's maximum, the most that the term can add to the score of any of its rows. Blocks are files in folders by a hash of the
term, sorted by term, so that a batch of questions reads the folders and row groups of its own terms. A frequent term's blocks are spread over several files.

In a search the blocks of a range meet in one task, which has the questions' weights. A question's bound for the range is the sum of what its terms' block maxima
may add; where that is below the k-th score that the task has found for the question, its blocks are passed over. Others are added up in one matrix
of questions by rows. That loses nothing: scores are the same as those of a scan. A task returns ``k`` rows a question, however many ranges it has.

The index doesn't change with the corpus: rows added later need a new one.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.columns import tokens
from quarry.operators.best import Best
from quarry.sources.store import stored, tasks, with_positions

K1, B, EPSILON = 1.5, 0.75, 0.25
#: So many terms of questions are sent to every task; a larger batch is cut into lots.
BROADCAST_TERMS = 200_000
#: Postings that a task collects before it passes them on.
PIECES = 1_000_000
#: Questions that are scored in one matrix.
PIECE = 256
#: Scores are rounded to 9 places, so a bound may be below one by this.
SLACK = 1e-8


def part(tf: Column, dl: Column, mean: Column) -> Column:
    """What a term adds to a row's score, without its weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def question_terms(questions: DataFrame) -> DataFrame:
    """``query_id, term, qtf``: repeated words of a question count each time."""
    return questions.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _postings(width: int):
    """For Arrow batches of ``ord, text``, pieces of blocks: of a word and a range the rows that the task has seen since it last emptied its lists, as triples of 32-bit numbers: place in the range, tf, dl."""
    word = re.compile(r"\w+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        at, ords, tfs, dls = [], [], [], []

        def emptied() -> pa.RecordBatch:
            t, o, f, d = (np.array(x, k) for x, k in ((at, np.int64), (ords, np.int64), (tfs, np.int32), (dls, np.int32)))
            order = np.lexsort((o, o // width, t))
            t, o, f, d = t[order], o[order], f[order], d[order]
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (o[1:] // width != o[:-1] // width)])
            triples = np.stack([o % width, f, d], 1).astype("<i4")
            ends = pa.py_buffer((12 * np.r_[starts, len(t)]).astype(np.int32))
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(triples.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()).take(pa.array(t[starts])), pa.array(o[starts] // width), lists], ["term", "range", "p"])

        for b in batches:
            for number, text in zip(b["ord"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = word.findall((text or "").lower())
                own = Counter(words)
                at += [known.setdefault(w, len(known)) for w in own]
                tfs += own.values()
                ords += [number] * len(own)
                dls += [len(words)] * len(own)
                if len(at) > PIECES:
                    yield emptied()
                    known, at, ords, tfs, dls = {}, [], [], [], []
        if at:
            yield emptied()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``n, words`` of the texts of a task."""
    word = re.compile(r"\w+")
    n = words = 0
    for b in batches:
        n += b.num_rows
        words += sum(len(word.findall((text or "").lower())) for text in b["text"].to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], ["n", "words"])


BLOCKS = "bucket int, term string, range long, top double, n int, ords array<long>, tfs array<int>, dls array<int>"


def _merged(width: int, mean: float):
    """For Arrow batches of pieces ``bucket, term, range, p``, sorted, their blocks. The last block of a batch waits for the next, which may have more of it."""

    def blocks(b: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(new)
        ends = np.frombuffer(b["p"].buffers()[1], np.int32)[b["p"].offset : b["p"].offset + b.num_rows + 1]
        triples = np.frombuffer(b["p"].buffers()[2], "<i4")[ends[0] // 4 : ends[-1] // 4].reshape(-1, 3)
        block = np.repeat(np.cumsum(new) - 1, np.diff(ends) // 12)
        order = np.lexsort((triples[:, 0], block))
        local, tf, dl = triples[order].T
        first = np.searchsorted(block, np.arange(len(starts)))
        lists = pa.array(np.append(first, len(block)), pa.int32())
        ords = local + np.repeat(b["range"].to_numpy()[starts] * width, np.diff(np.append(first, len(block))))
        top = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)), first)
        named = [b[c].take(pa.array(starts)) for c in ("bucket", "term", "range")]
        parts = [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (ords.astype(np.int64), tf.astype(np.int32), dl.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*named, pa.array(top), pa.array(np.diff(np.append(first, len(block))).astype(np.int32)), *parts], ["bucket", "term", "range", "top", "n", "ords", "tfs", "dls"])

    def starts_of(b: pa.RecordBatch) -> np.ndarray:
        new = np.ones(b.num_rows, bool)
        for c in ("term", "range"):
            other = pc.not_equal(b[c].slice(1), b[c].slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = other if c == "term" else new[1:] | other
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            b = b if held is None else pa.concat_batches([held, b])
            if b.num_rows:
                new = starts_of(b)
                last = int(np.flatnonzero(new)[-1])
                if last:
                    yield blocks(b.slice(0, last), new[:last])
                held = b.slice(last)
        if held is not None:
            yield blocks(held, starts_of(held))

    return run


@dataclass(frozen=True)
class KeywordIndex:
    """``blocks(bucket, term, range, top, n, ords, tfs, dls)``, ``terms(bucket, term, df, idf)``, and the numbers of the whole corpus."""

    blocks: DataFrame
    terms: DataFrame
    rows: int
    mean: float
    buckets: int
    width: int

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def write_index(corpus: DataFrame, path: str, text: str = "content", *, buckets: int = 64, width: int = 1024) -> None:
    """Index ``corpus(ord, <text>)``, in place of what is at ``path``. ``ord`` should be unique and rather dense.

    Texts are read twice, first for their mean length. Postings are shuffled once, to the files in which they stay; what is known of terms is counted from these.
    """
    rows = corpus.select(F.col("ord").cast("long").alias("ord"), F.col(text).alias("text"))
    spark = corpus.sparkSession
    whole = rows.select("text").mapInArrow(_counted, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    whole = stored(whole.withColumns({"mean": F.col("words") / F.greatest("n", F.lit(1)), "buckets": F.lit(buckets), "width": F.lit(width)}), "about")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    n = tasks(spark)
    pieces = rows.mapInArrow(_postings(width), "term string, range long, p binary").withColumn("bucket", bucket)
    dealt = pieces.repartition(n, "bucket", F.pmod("range", F.lit(-(-n // buckets)))).sortWithinPartitions("bucket", "term", "range").select("bucket", "term", "range", "p")
    dealt.mapInArrow(_merged(width, whole.head()["mean"]), BLOCKS).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.schema("term string, n int, bucket int").parquet(f"{path}/blocks")
    counts = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    raw = stored(counts.crossJoin(F.broadcast(whole)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf0")), "term-weights")
    floor = raw.agg((F.lit(EPSILON) * F.avg("idf0")).alias("least"))
    idf = F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(F.col("least"))
    terms = raw.crossJoin(F.broadcast(floor)).select(bucket.alias("bucket"), "term", "df", idf.alias("idf"))
    terms.repartition(n, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    whole.write.mode("overwrite").parquet(f"{path}/about")


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    """The index at ``path``."""
    about = spark.read.parquet(f"{path}/about").head()
    blocks = spark.read.schema("term string, range long, top double, n int, ords array<long>, tfs array<int>, dls array<int>, bucket int").parquet(f"{path}/blocks")
    terms = spark.read.schema("term string, df long, idf double, bucket int").parquet(f"{path}/terms")
    return KeywordIndex(blocks, terms, about["n"], about["mean"], about["buckets"], about["width"])


def _weights(index: KeywordIndex, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``query_id, bucket, term, weight`` of the questions' terms that the index knows, and the blocks in their folders."""
    asked = stored(question_terms(questions).withColumn("bucket", index.bucket(F.col("term"))), "asked")
    folders = [r[0] for r in asked.select("bucket").distinct().collect()]  # at most as many as there are
    known = index.terms.filter(F.col("bucket").isin(folders))
    weights = known.join(asked, ["bucket", "term"]).select("query_id", "bucket", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    return stored(weights, "weights"), index.blocks.filter(F.col("bucket").isin(folders))


def scores(index: KeywordIndex, questions: DataFrame) -> DataFrame:
    """``query_id, ord, score`` of all rows that share a word with the question, rounded to 9 places."""
    weights, blocks = _weights(index, questions)
    rows = blocks.join(weights, ["bucket", "term"]).select("query_id", "weight", F.explode(F.arrays_zip("ords", "tfs", "dls")).alias("x"))
    one = F.col("weight") * part(F.col("x.tfs"), F.col("x.dls"), F.lit(index.mean))
    return rows.select("query_id", F.col("x.ords").alias("ord"), one.alias("part")).groupBy("query_id", "ord").agg(F.round(F.sum("part"), 9).alias("score"))


class Ranges:
    """Scores blocks that come range by range, for questions whose weights are given by term as (questions, weights)."""

    def __init__(self, weights: dict[str, tuple[np.ndarray, np.ndarray]], n: int, k: int, mean: float, width: int):
        self.weights, self.n, self.mean, self.width = weights, n, mean, width
        self.best = Best(n, k)
        self.visited = self.there = 0

    def add(self, number: int, blocks: list[tuple], allowed: tuple[np.ndarray, np.ndarray] | None) -> None:
        """``blocks`` of ``term, top, ords, tfs, dls``; ``allowed`` are the rows that count and the numbers by which they are named and ordered."""
        bound, asks = np.zeros(self.n), np.zeros(self.n, bool)
        for term, top, *_ in blocks:
            q, w = self.weights[term]
            bound[q] += np.maximum(0.0, w * top)
            asks[q] = True
        active = np.flatnonzero(asks & (-(bound + SLACK) <= self.best.last))
        self.there += int(asks.sum())
        self.visited += len(active)
        if not len(active):
            return
        at = np.full(self.n, -1)
        at[active] = np.arange(len(active))
        parts = []
        for term, _, ords, tfs, dls in blocks:
            q, w = self.weights[term]
            mine = at[q] >= 0
            if mine.any():
                tf = tfs.astype(np.float64)
                parts.append((at[q[mine]], w[mine], ords - number * self.width, tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls / self.mean))))
        columns, names = (np.arange(self.width), number * self.width + np.arange(self.width)) if allowed is None else (allowed[0] - number * self.width, allowed[1])
        for lo in range(0, len(active), PIECE):
            size = min(PIECE, len(active) - lo)
            total, touched = np.zeros((size, self.width)), np.zeros((size, self.width), bool)
            for rows, w, local, one in parts:
                inside = (rows >= lo) & (rows < lo + size)
                if inside.any():
                    cells = np.ix_(rows[inside] - lo, local)
                    total[cells] += w[inside, None] * one
                    touched[cells] = True
            worst = np.where(touched, -np.round(total, 9), np.inf)[:, columns]
            if worst.shape[1]:
                self.best.add(active[lo : lo + size], worst, names)


def _ranges(batches: Iterator[pa.RecordBatch], scorer: Ranges, filtered: bool) -> Ranges:
    """Feed rows ``range, kind, term, top, ords, tfs, dls``, sorted by range and kind, to a scorer; kind 0 has the rows of a range that count."""
    now, blocks, allowed = None, [], None

    def done() -> None:
        if blocks and (allowed is not None or not filtered):
            scorer.add(now, blocks, allowed)

    for b in batches:
        ends = {c: b[c].offsets.to_numpy() for c in ("ords", "tfs", "dls")}
        flat = {c: b[c].values.to_numpy(zero_copy_only=False) for c in ends}
        for i, (number, kind, term, top) in enumerate(zip(*(b[c].to_pylist() for c in ("range", "kind", "term", "top")), strict=True)):
            if number != now:
                done()
                now, blocks, allowed = number, [], None
            ords, tfs, dls = (flat[c][ends[c][i] : ends[c][i + 1]] for c in ends)
            if kind == 0:
                allowed = ords, dls
            else:
                blocks.append((term, top, ords, tfs, dls))
    done()
    return scorer


def search(index: KeywordIndex, questions: DataFrame, k: int, *, allowed: DataFrame | None = None, tie: tuple[str, ...] = ("ord",)) -> DataFrame:
    """``query_id, rank, ord, score``: the ``k`` best rows of each question, ranks from 0, of equals those first by ``tie``.

    ``allowed(ord, ...)`` are the rows that may be found, with the columns of ``tie``; without it all may.
    """
    weights, blocks = _weights(index, questions)
    kind = weights.schema["query_id"].dataType.simpleString()
    columns = ("range", "kind", "term", "top", "ords", "tfs", "dls")
    side = blocks.select("range", F.lit(1).alias("kind"), "term", "top", "ords", F.col("tfs").cast("array<long>").alias("tfs"), F.col("dls").cast("array<long>").alias("dls"))
    named = None
    if allowed is not None:
        # rows are named by their place in the order of `tie`, which is that of their numbers if nothing else is asked for
        named = with_positions(allowed.select("ord", *[c for c in tie if c != "ord"]), *tie, name="place") if tie != ("ord",) else allowed.select("ord", F.col("ord").alias("place"))
        lists = named.groupBy(F.floor(F.col("ord") / index.width).cast("long").alias("range")).agg(F.sort_array(F.collect_list(F.struct("ord", "place"))).alias("p"))
        none = F.array().cast("array<long>")
        count = lists.select("range", F.lit(0).alias("kind"), F.lit("").alias("term"), F.lit(0.0).alias("top"), F.col("p.ord").alias("ords"), none.alias("tfs"), F.col("p.place").alias("dls"))
    found = None
    n = -(-weights.count() // BROADCAST_TERMS)
    for lot in range(max(1, n)):
        own = weights if n <= 1 else weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == lot)
        run = _scoring(index, own, k, allowed is not None)
        met = side.join(own.select("term").distinct(), "term", "left_semi").select(*columns)
        met = met if allowed is None else met.unionByName(count)
        met = met.repartition(tasks(questions.sparkSession), "range").sortWithinPartitions("range", "kind", "term")
        one = met.mapInArrow(run, f"query_id {kind}, place long, score double")
        found = one if found is None else found.unionByName(one)
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place")
    found = found.withColumn("rank", F.row_number().over(place) - 1).filter(F.col("rank") < k)
    if tie != ("ord",) and named is not None:
        return found.join(named, "place").select("query_id", "rank", "ord", "score")
    return found.select("query_id", "rank", F.col("place").alias("ord"), "score")


def scorer_of(index: KeywordIndex, weights: DataFrame, k: int) -> tuple[Ranges, pa.Array]:
    """A scorer for a lot of questions, and their ids."""
    rows = weights.select("query_id", "term", "weight").toArrow()
    ids = rows["query_id"].combine_chunks().dictionary_encode()
    by: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    for q, term, w in zip(ids.indices.to_pylist(), rows["term"].to_pylist(), rows["weight"].to_pylist(), strict=True):
        by[term][0].append(q)
        by[term][1].append(w)
    known = {t: (np.array(q, np.int64), np.array(w)) for t, (q, w) in by.items()}
    return Ranges(known, len(ids.dictionary), k, index.mean, index.width), ids.dictionary


def _scoring(index: KeywordIndex, weights: DataFrame, k: int, filtered: bool):
    scorer, names = scorer_of(index, weights, k)
    sent = weights.sparkSession.sparkContext.broadcast((scorer, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, names = sent.value
        own = Ranges(shared.weights, shared.n, k, shared.mean, shared.width)
        best = _ranges(batches, own, filtered).best
        yield pa.RecordBatch.from_arrays([names.take(pa.array(best.q)), pa.array(best.ord), pa.array(-best.worst)], ["query_id", "place", "score"])

    return run
