"""SimHash near-duplicate detection by a binary trie self-join.

Fingerprints of 64 bits that differ in at most ``budget`` bits are linked, and the
links' connected components are the groups of near duplicates.

* Equal fingerprints are one class from the start; only distinct ones are joined.
* The trie of all classes is dealt out to tasks: ``budget + e`` blocks of the 64 bits are chosen. Two fingerprints within
  the budget agree on ``e`` blocks at least, so they meet under the key made of some ``e`` blocks.
  Blocks are as few and as narrow as leave ``MEAN`` classes to an even group: up to so many classes there is one trie,
  beyond it each key has tries of that size or a few times as much, deep enough for the error budget to drop most pairs of nodes.
* Inside a group its members, sorted, are a binary trie: a node is a range of the sorted
  array. The join walks pairs of nodes from the root together, both by one bit,
  adds one to the pair's errors where the bits differ, and drops the pair beyond the budget.
  Pairs of nodes with a few members, too few levels to use up what is left of the budget, are leaves: their members are compared at once. The tries of many groups are walked
  together: all pairs of one depth are handled by one step on arrays, in slabs of bounded size.
* A group returns a spanning forest of its links, not the links, so a dense group of n
  fingerprints returns n - 1 rows at most.
* A group of more than ``GROUP`` members is cut into chunks by hash, and every two chunks are
  joined by a task of their own, tries of different chunks just as the trie with itself.

Defined results: null text is the empty text; texts without words have fingerprint 0 and are linked
like any other; rows that share a doc_id are linked by their fingerprints only, so they may be in different
components; a null doc_id names no component that has another id, and a component of null ids alone has the id null; rows that repeat
are in one component; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected
from quarry.llm.scratch import stored, tasks

#: Members of a group that one task joins at most with as many others.
GROUP = 1 << 16
#: Pairs of nodes that one step handles at most, and pairs of members that are compared at once.
SLAB, PAIRS = 1 << 15, 1 << 16
#: Pairs of nodes with so many pairs of members are leaves; of those that the budget can't prune further, with so many.
LEAF, WIDE_LEAF = 16, 4096
#: Members of all groups that are joined together, and of one group on average.
TOGETHER, MEAN = 1 << 16, 1 << 13


def fingerprint(text: str | None, words: int = 4, seed: int = 42, prints: int = 1) -> list[int]:
    """``prints`` SimHashes of one text: the first over XXH64 hashes of its shingles of ``words`` words, the others over these hashes mixed anew."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not w:
        return [0] * prints
    joined, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts, stops = np.concatenate([[0], ends[: len(w) - k]]).tolist(), (ends[k - 1 :] - 1).tolist()
    counts, n, digest = np.zeros((prints, 64), np.int64), len(stops), xxhash.xxh64_digest
    for i in range(0, n, 65536):
        raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[i : i + 65536], stops[i : i + 65536], strict=True)])
        h = np.frombuffer(raw, ">u8")
        for p in range(prints):
            counts[p] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)  # the highest bit first
            h = _mixed(h.astype(np.uint64))
    return [int.from_bytes(np.packbits(2 * c > n).tobytes(), "big") for c in counts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return (h ^ (h >> np.uint64(35))) * np.uint64(0xD6E8FEB86659FD93)


def fingerprints(docs: DataFrame, *, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) for each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words, seed)[0] for t in b["text"]), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def trie_join(values: np.ndarray, roots: tuple[np.ndarray, ...], budget: int, tally: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``budget`` bits, as two arrays of indexes into ``values``.

    ``values`` are runs of sorted distinct uint64, each a trie; ``roots`` are four arrays: from where to where in ``values``
    the tries to join reach, left and right. A trie is joined with itself where both are the same. ``tally`` gets the numbers of pairs
    of members that were ``pruned`` by the budget, ``connected`` already, and ``compared`` (inside one leaf node in both orders).
    """
    label = np.arange(len(values))
    none = label[:0]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    # a slab: depth, ranges of the left and the right nodes in `values`, errors so far
    stack = [(0, *roots, np.zeros(len(roots[0]), np.int64))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > SLAB:
            half = len(al) // 2
            stack += [(depth, *[x[part] for x in (al, ah, bl, bh, err)]) for part in (slice(half, None), slice(0, half))]
            continue
        # pairs whose members are all connected already have nothing to add
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        open_ = (label[al] != label[bl]) | (change[al] != change[ah - 1]) | (change[bl] != change[bh - 1])
        if tally is not None:
            tally["connected"] += int(((ah - al) * (bh - bl))[~open_].sum())
        al, ah, bl, bh, err = (v[open_] for v in (al, ah, bl, bh, err))
        size = (ah - al) * (bh - bl)
        # the budget prunes nothing in an even trie whose levels, all of them errors, don't use it up
        levels = np.ceil(np.log2(np.maximum(ah - al, bh - bl))).astype(np.int64)
        leaf = (size <= LEAF) | ((err + levels <= budget) & (size <= WIDE_LEAF)) | (depth == 64)
        if leaf.any():
            low, high, other, end = (v[leaf] for v in (al, ah, bl, bh))
            own, wide = high - low, end - other
            # a row for each left member, with the range of its right ones; then some PAIRS pairs at a time
            left = np.arange(own.sum()) + np.repeat(low - np.cumsum(own) + own, own)
            first, count = np.repeat(other, own), np.repeat(wide, own)
            ends = np.cumsum(count)
            if tally is not None:
                tally["compared"] += int(ends[-1])
            cut = np.searchsorted(ends, np.arange(PAIRS, ends[-1] + PAIRS, PAIRS), "left") + 1
            for lo, hi in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                m = count[lo:hi]
                x = np.repeat(left[lo:hi], m)
                y = np.arange(len(x)) + np.repeat(first[lo:hi] - np.cumsum(m) + m, m)
                near = (np.bitwise_count(values[x] ^ values[y]) <= budget) & (label[x] != label[y])  # links inside a component add nothing
                if near.any():
                    out.append(_forest(label, x[near], y[near]))
            al, ah, bl, bh, err = (v[~leaf] for v in (al, ah, bl, bh, err))
        if not len(al):
            continue
        am, bm = _split(values, al, ah, depth), _split(values, bl, bh, depth)
        same = (al == bl) & (ah == bh)
        parts = [
            (al, am, bl, bm, err),
            (am, ah, bm, bh, err),
            (al, am, bm, bh, err + 1),
            tuple(v[~same] for v in (am, ah, bl, bm, err + 1)),
        ]
        nal, nah, nbl, nbh, nerr = (np.concatenate(v) for v in zip(*parts, strict=True))
        live = (nal < nah) & (nbl < nbh) & (nerr <= budget)
        if tally is not None:
            tally["pruned"] += int(((nah - nal) * (nbh - nbl))[nerr > budget].sum())
        if live.any():
            stack.append((depth + 1, *(v[live] for v in (nal, nah, nbl, nbh, nerr))))
    if not out:
        return none, none
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """For each node, a range of sorted ``values``, the first member whose bit at ``depth`` (0: the highest) is 1."""
    bit = np.uint64(63 - depth)
    low, high = lo.copy(), hi.copy()
    for _ in range(int((hi - lo).max()).bit_length()):
        open_ = low < high
        mid = (low + high) >> 1
        one = ((values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _forest(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add links to the components in ``label`` (in place); the links that joined two of them."""
    gx, gy = [], []
    while len(x):
        lx, ly = label[x], label[y]
        new = lx != ly
        x, y, lx, ly = x[new], y[new], lx[new], ly[new]
        if not len(x):
            break
        # each component takes its first link to a smaller one: no circles, as labels fall
        big, small = np.maximum(lx, ly), np.minimum(lx, ly)
        parent, at = np.unique(big, return_index=True)
        gx.append(x[at])
        gy.append(y[at])
        root = np.arange(len(label))
        root[parent] = small[at]
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label[:] = root[label]
    none = label[:0]
    return (np.concatenate(gx), np.concatenate(gy)) if gx else (none, none)


def block_keys(classes: int, budget: int, least: int | None = None, most: int | None = None) -> list[list[tuple[int, int]]]:
    """For each key, the (shift, width) of its blocks, where an even group has about ``least`` (``MEAN``) to ``most`` (4 ``MEAN``) classes.

    The fewest blocks that leave ``most`` at most, made narrower while that leaves ``least``. One key without
    blocks, hence one trie, if there are no more classes than ``least``.
    """
    least, most = least or MEAN, most or 4 * MEAN
    if classes <= least:
        return [[]]
    for extra in range(1, 8):
        n = budget + extra
        if classes / 2 ** (64 * extra / n) <= most:
            break
    edges = [64 * i // n for i in range(n + 1)]
    width = max(1, round(math.log2(classes / least) / extra))
    sizes = [min(width, b - a) for a, b in pairwise(edges)]
    return [list(c) for c in combinations([(64 - a - size, size) for a, size in zip(edges, sizes, strict=False)], extra)]


def key_bits(fp: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The bits of some blocks of each fingerprint, one after the other."""
    bits = np.zeros(len(fp), np.uint64)
    for shift, width in blocks:
        bits = bits << np.uint64(width) | fp >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return bits


def links(classes: DataFrame, *, budget: int = 4, least: int | None = None, most: int | None = None) -> DataFrame:
    """``set, a, b``: fingerprints within ``budget`` bits, a spanning forest of each group's links, from distinct ``set, fp``.

    ``set`` (int) numbers sets of fingerprints, of which none is compared with another's. ``least`` and ``most`` are
    the classes of an even group (``block_keys``); a wide budget prunes little and wants small ones.
    """
    spark = classes.sparkSession
    sizes = classes.groupBy("set").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).head()
    keys = block_keys(sizes[0] or 0, budget, least, most)
    n_keys, wide = len(keys), max(sum(w for _, w in k) for k in keys)
    if wide + (n_keys * (sizes[1] or 1)).bit_length() > 62:
        raise ValueError("too many sets of fingerprints")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, fp = b["set"].to_numpy().astype(np.int64), b["fp"].to_numpy().view(np.uint64)
            for i, blocks in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array((of * n_keys + i) << wide | key_bits(fp, blocks).astype(np.int64)), b["fp"]], ["g", "fp"])

    rows = classes.select("set", "fp")
    # large groups are known from a part of the classes that holds 16 times GROUP of a set at least
    part = max(1, (sizes[0] or 0) // (16 * GROUP))
    seen = rows.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).mapInArrow(keyed, "g long, fp long")
    large = stored(seen.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") * part > GROUP).select(F.col("g").alias("l_g"), (F.col("n") * part).alias("n")), "simhash-large")
    near = rows.repartition(tasks(spark), "fp").mapInArrow(keyed, "g long, fp long")
    at = large.count()
    # at most 16 n_keys of them in a set
    near = near.join(F.broadcast(large) if at <= 100_000 else large, F.col("g") == F.col("l_g"), "left") if at else near.withColumn("n", F.lit(None).cast("long"))
    chunks = F.coalesce(F.ceil(F.col("n") / (GROUP // 2)), F.lit(1)).cast("int")
    near = near.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    near = near.withColumn("other", other) if at else near.withColumn("other", F.lit(0))
    near = near.select("g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine").alias("c"), "fp")
    near = near.repartition(tasks(spark), "g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, group, i, j, c, values in _groups(batches):
            order = np.lexsort((values, c, group))
            g, group, i, j, c, values = (x[order] for x in (g, group, i, j, c, values))
            # runs of one group and chunk, and which of them are joined: those of a group's two chunks, or one with itself
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (c[1:] != c[:-1])])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(values))
            alone = (i[lo] == j[lo]) & (hi - lo > 1)
            pair = np.flatnonzero(group[lo][1:] == group[lo][:-1])
            left, right = np.concatenate([np.flatnonzero(alone), pair]), np.concatenate([np.flatnonzero(alone), pair + 1])
            if not len(left):
                continue
            x, y = trie_join(values, (lo[left], hi[left], lo[right], hi[right]), budget)
            if len(x):
                found = [pa.array(((g[x] >> wide) // n_keys).astype(np.int32)), pa.array(values[x].view(np.int64)), pa.array(values[y].view(np.int64))]
                yield pa.RecordBatch.from_arrays(found, ["set", "a", "b"])

    return near.mapInArrow(run, "set int, a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Key, number of the group, chunks, own chunk and fingerprint of whole groups, some ``TOGETHER`` members at a time; few groups have more than GROUP."""
    held: list[list[np.ndarray]] = []
    size = 0

    def cut(last: bool) -> tuple[np.ndarray, ...] | None:
        nonlocal held, size
        g, i, j, c, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        stop = len(g) if last else int(np.flatnonzero(new)[-1])
        rest = [x[stop:] for x in (g, i, j, c, fp)]
        held, size = [rest], len(rest[0])
        return None if not stop else tuple(x[:stop] for x in (g, np.cumsum(new), i, j, c, fp.view(np.uint64)))

    for batch in batches:
        if batch.num_rows:
            held.append([batch[n].to_numpy(zero_copy_only=False) for n in ("g", "i", "j", "c", "fp")])
            size += batch.num_rows
        if size >= TOGETHER and (whole := cut(False)):
            yield whole
    if size and (whole := cut(True)):
        yield whole


def near_duplicates(docs: DataFrame, *, words: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``; the component's smallest doc_id is its id."""
    prints = stored(fingerprints(docs, words=words, seed=seed), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = stored(links(classes.select(F.lit(0).alias("set"), "fp"), budget=budget), "simhash-links")
    # only classes with a link to another need the search for components
    edges = found.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = connected(edges).select(F.col("node").alias("n_fp"), "root")
    placed = classes.join(roots, F.col("fp") == F.col("n_fp"), "left").withColumn("root", F.coalesce("root", "fp")).select("fp", "rep", "root")
    placed = stored(placed, "simhash-placed")
    names = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(names, "root").select(F.col("fp").alias("c_fp"), "component_id")
    return prints.join(named, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits of the bits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
