"""Near copies: pairs that the SimHash trie join finds, checked by the Jaccard similarity of their word shingles.

A text is the set of its shingles of ``words`` words (of all its words, if it has fewer). Two texts are near copies if their sets'
similarity is ``percent`` % or more; the links' connected components are the groups of near copies.

1. Equal texts are one class. Each class has ``prints`` SimHashes of 64 bits; for each of these the trie join (:mod:`quarry.llm.simhash`)
   finds all pairs within ``budget`` bits, as spanning forests. Classes with an equal SimHash are linked to the smallest of them.
   At a similarity of s two SimHashes differ in 64 acos(2 s / (1 + s)) / pi bits on average (9.7 at 0.8, 6.6 at 0.9), so a pair
   is found by one of them or through others of its group; the README has the recall that was measured.
2. A pair that is further apart over all SimHashes than ``FAR`` of their bits is dropped: at 0.8 that is four standard deviations away.
3. In each group of pairs the class with most of them is compared with all others of the group, set by set; what
   pairs are left that this did not join are then compared one by one. So the sets that are
   moved grow with the classes and the pairs found, not with the square of a group, and no group is held by one task.

Defined results: null text is the empty text; texts without words are near copies of each other and of no other; a null doc_id
is a value like any other; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected
from quarry.llm.scratch import stored
from quarry.llm.simhash import fingerprint, links

#: Share of all SimHashes' bits in which a pair that is compared differs at most.
FAR = 0.25
#: Whether each group's best connected class is compared with the others first; without, all pairs found are compared one by one.
STARS = True


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted different hashes of a text's shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    joined, k, digest = b" ".join(w), min(words, len(w)), xxhash.xxh64_digest
    if not w:
        return np.frombuffer(digest(b""), np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts, stops = np.concatenate([[0], ends[: len(w) - k]]).tolist(), (ends[k - 1 :] - 1).tolist()
    return np.unique(np.frombuffer(b"".join([digest(joined[s:e]) for s, e in zip(starts, stops, strict=True)]), np.uint64))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets' Jaccard similarity is ``percent`` % or more."""
    total = len(a) + len(b)
    if (100 + percent) * min(len(a), len(b)) < percent * total:
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return (100 + percent) * shared >= percent * total


def text_key(text: Column) -> Column:
    """The class of a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _prints(docs: DataFrame, words: int, prints: int) -> DataFrame:
    """``key, fps``: the SimHashes of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, prints=prints) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(list(fp), pa.list_(pa.int64()))], ["key", "fps"])

    made = docs.select("key", "text").mapInArrow(run, "key long, fps array<long>")
    return stored(made.groupBy("key").agg(F.first("fps").alias("fps")), "similar-prints")


def _pairs(prints: DataFrame, n: int, budget: int) -> DataFrame:
    """``src, dst`` (src < dst): pairs of classes that the trie join finds and that aren't too far apart over all ``n`` SimHashes."""
    each = prints.select("key", F.posexplode("fps").alias("set", "fp"))
    first = stored(each.groupBy("set", "fp").agg(F.min("key").alias("rep")), "similar-sets")
    found = stored(links(first.select("set", "fp"), budget=budget, least=16, most=256), "similar-links")
    a, b = (first.select(F.col("set").alias(f"{x}_set"), F.col("fp").alias(f"{x}_fp"), F.col("rep").alias(f"{x}_rep")) for x in "ab")
    linked = found.join(a, (F.col("set") == F.col("a_set")) & (F.col("a") == F.col("a_fp"))).join(b, (F.col("set") == F.col("b_set")) & (F.col("b") == F.col("b_fp")))
    same = each.join(first.select(F.col("set").alias("f_set"), F.col("fp").alias("f_fp"), "rep"), (F.col("set") == F.col("f_set")) & (F.col("fp") == F.col("f_fp")))
    pairs = linked.select(F.col("a_rep").alias("x"), F.col("b_rep").alias("y")).unionByName(same.select(F.col("rep").alias("x"), F.col("key").alias("y")))
    pairs = pairs.filter("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct()
    own = [prints.select(F.col("key").alias(f"{x}_key"), F.col("fps").alias(f"{x}_fps")) for x in "ab"]
    pairs = pairs.join(own[0], F.col("src") == F.col("a_key")).join(own[1], F.col("dst") == F.col("b_key"))
    apart = F.aggregate(F.zip_with("a_fps", "b_fps", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return stored(pairs.filter(apart <= int(FAR * 64 * n)).select("src", "dst"), "similar-pairs")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``s_key, own``: the shingles of the wanted classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([shingles(t.as_py(), words).tobytes() for t in b["text"]], pa.binary())], ["s_key", "own"])

    # of a class's rows one is enough; the copies that a third of all rows may be are dropped before the text is moved
    met = docs.select("key", "text").join(wanted, F.col("key") == F.col("node"), "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return stored(met.mapInArrow(run, "s_key long, own binary"), "similar-texts")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``src, dst`` whose sets are similar enough."""
    a, b = (sets.select(F.col("s_key").alias(f"{x}_key"), F.col("own").alias(f"{x}_own"), F.octet_length("own").alias(f"{x}_n")) for x in "ab")
    # sizes settle some pairs before any set is moved
    sizes = (F.lit(100) * F.least("a_n", "b_n")) >= F.lit(percent) * F.greatest("a_n", "b_n")
    small = pairs.join(a.drop("a_own"), F.col("src") == F.col("a_key")).join(b.drop("b_own"), F.col("dst") == F.col("b_key")).filter(sizes).select("src", "dst")
    met = small.join(a, F.col("src") == F.col("a_key")).join(b, F.col("dst") == F.col("b_key")).select("src", "dst", "a_own", "b_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["a_own"], batch["b_own"], strict=True)
            near = pa.array([alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["src"], batch["dst"]], ["src", "dst"]).filter(near)

    return met.mapInArrow(run, "src long, dst long")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components of ``joined(node, root)``."""
    a, b = (joined.select(F.col("node").alias(f"{x}_node"), F.col("root").alias(f"{x}_root")) for x in "ab")
    met = pairs.join(a, F.col("src") == F.col("a_node"), "left").join(b, F.col("dst") == F.col("b_node"), "left")
    return met.filter(F.coalesce("a_root", "src") != F.coalesce("b_root", "dst")).select("src", "dst")


def similar_classes(docs: DataFrame, *, words: int, percent: int, budget: int, prints: int) -> DataFrame:
    """``node, root`` for each class of ``docs(key, text)`` that has a near copy: the component's smallest class."""
    pairs = _pairs(_prints(docs, words, prints), prints, budget)
    groups = stored(connected(pairs), "similar-groups").select(F.col("node").alias("g_node"), F.col("root").alias("g"))
    sets = _sets(docs, groups.select(F.col("g_node").alias("node")), words)
    if not STARS:
        return connected(stored(_alike(pairs, sets, percent), "similar-good"))
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("n")).join(groups, F.col("node") == F.col("g_node"))
    best = degree.groupBy(F.col("g").alias("b_g")).agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("best"))
    star = groups.join(best, F.col("g") == F.col("b_g")).filter("g_node <> best").select(F.col("g_node").alias("src"), F.col("best").alias("dst"))
    star = stored(_alike(star, sets, percent), "similar-star")
    # the star's links name their components: both ends have the group's best class as root
    joined = star.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    rest = _alike(_apart(pairs, joined), sets, percent)
    return connected(stored(star.unionByName(rest), "similar-good"))


def similar_documents(docs: DataFrame, *, words: int = 5, percent: int = 80, budget: int = 10, prints: int = 2) -> DataFrame:
    """``doc_id, key, root`` for each row of ``docs(doc_id, text)``: its class and the component's smallest class."""
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    roots = similar_classes(docs, words=words, percent=percent, budget=budget, prints=prints).select(F.col("node").alias("r_key"), "root")
    return docs.select("doc_id", "key").join(roots, F.col("key") == F.col("r_key"), "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
