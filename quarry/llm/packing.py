"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

Pieces of equal length are interchangeable, so the plan is made on the histogram of lengths, which
has at most ``capacity`` bars however many documents there are. The plan is a list of patterns
(lengths that fill one sequence) with the number of sequences of each; its size depends on the
histogram's bars only. The reduction fixes a largest length j with its best partner k, as often as both
last, wherever {j, k} provably dominates every other set with j: they fill the sequence, or no
two others fit beside j, or at most two fit and no two are worth more than k. What remains is packed
best-fit by decreasing length. Pieces then get numbers within their length, from totals of hash
ranges and the place inside one range, and find their sequence by the number; a length with
a third of all pieces is so spread over all tasks.

Defined results: null or empty text is one piece with the closing id alone; rows that repeat entirely are packed
each for itself; a null doc_id is kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import encoder
from quarry.llm.scratch import stored, tasks

Pattern = tuple[tuple[int, int], ...]  # (length, how many), in the order in which they are placed


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, closing: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids, cut only where they exceed ``capacity``.

    ``tokenizer`` is the path of a tokenizer file, which every executor must be able to open.
    """
    rows = docs.select("doc_id", "text")
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                at, part, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(code.encode([t or "" for t in b["text"].to_pylist()])):
                    ids += end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[lo : lo + 4 * capacity]
                        at.append(i)
                        part.append(k)
                        start.append(lo // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def reduce_instance(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Take out of ``left`` (length: how many) the sets that dominate all alternatives; the sequences they make."""
    fixed: list[tuple[Pattern, int]] = []
    present = sorted(k for k, n in left.items() if n)

    def take(items: list[int], times: int) -> None:
        fixed.append((tuple((x, 1) for x in items), times))
        for x in items:
            left[x] -= times
            if not left[x]:
                del left[x], present[bisect_left(present, x)]

    def smallest(j: int, k: int) -> list[int]:
        """The k smallest items besides one of length j."""
        out: list[int] = []
        for x in present:
            out += [x] * min(k - len(out), left[x] - (x == j))
            if len(out) == k:
                break
        return out

    def best_pair(j: int, room: int) -> int:
        """The largest sum up to ``room`` of two items besides one of length j."""
        lo, hi, best = 0, bisect_right(present, room) - 1, 0
        while lo <= hi:
            a, b = present[lo], present[hi]
            have = left[a] - (a == j), left[b] - (b == j)
            if a + b > room or have[1] < 1:
                hi -= 1
            elif have[0] < 1 or (lo == hi and have[0] < 2):
                lo += 1
            else:
                best = max(best, a + b)
                lo += 1
        return best

    changed = True
    while changed and present:
        changed = False
        for j in present[::-1]:
            while left.get(j):
                room = capacity - j
                at = bisect_right(present, room) - 1
                if at >= 0 and present[at] == j and left[j] == 1:
                    at -= 1
                if at < 0:  # nothing fits beside j
                    take([j], left[j])
                    changed = True
                    break
                k = present[at]
                times = left[j] // 2 if j == k else min(left[j], left[k])
                if k < room:
                    low = smallest(j, 3)
                    two_fit = len(low) > 1 and low[0] + low[1] <= room
                    three_fit = len(low) > 2 and sum(low) <= room
                    if two_fit and (three_fit or best_pair(j, room) > k):
                        break
                take([j, k], times)
                changed = True
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing; open sequences of equal contents are handled together."""
    room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(free: int, pattern: Pattern, times: int) -> None:
        if free not in room or not room[free]:
            insort(rooms, free)
        room[free].append((pattern, times))

    done: list[tuple[Pattern, int]] = []
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                free = rooms[at]
                pattern, times = room[free].pop()
                if not room[free]:
                    del rooms[at]
                each = free // x  # best fit keeps filling the sequence that it has begun
                if n >= each:
                    used = min(times, n // each)
                    k = each
                else:
                    used, k = 1, n
                if used < times:
                    put(free, pattern, times - used)
                n -= used * k
                pattern, free, times = (*pattern, (x, k)), free - k * x, used
            else:
                each = capacity // x
                times, k = (n // each, each) if n >= each else (1, n)
                n -= times * k
                pattern, free = ((x, k),), capacity - k * x
            if free:
                put(free, pattern, times)
            else:
                done.append((pattern, times))
    return done + [p for free in rooms for p in room[free]]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and the number of sequences of each, which use every length as often as the histogram has it."""
    left = {k: n for k, n in histogram.items() if n}
    full = [(((capacity, 1),), left.pop(capacity))] if capacity in left else []
    fixed = reduce_instance(left, capacity)
    return full + fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Ranges of the numbers of each length, sorted: from ``first`` on, ``each`` in a sequence, from sequence ``base`` and place ``offset`` on."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, base, offset))
            used[length] += times * each
            offset += length * each
        base += times
    rows.sort()
    names = ("length", "first", "each", "base", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(found: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """``found`` (as from :func:`pieces`) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    found = stored(found, "pieces")
    ranges = 8 * tasks(spark)
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ranges)).cast("int")
    rows = found.withColumn("part", part)
    cells = stored(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one bar for each length, `capacity` at most
    bars = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(plan(bars, capacity))
    cells = cells.select(F.col("length").alias("c_length"), F.col("part").alias("c_part"), before.alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("n", F.row_number().over(inside)).join(cells, (F.col("length") == F.col("c_length")) & (F.col("part") == F.col("c_part")))
    names = found.columns
    rows = rows.select(*names, (F.col("before") + F.col("n") - 1).alias("number"))
    sent = spark.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        edge = np.searchsorted(s["length"], np.arange(capacity + 2))
        for b in batches:
            length, number = b["length"].to_numpy(), b["number"].to_numpy()
            # the last range of the length that begins at the number or before
            lo, hi = edge[length], edge[length + 1]
            while (open_ := hi - lo > 1).any():
                mid = (lo + hi) // 2
                above = s["first"][np.minimum(mid, len(s["first"]) - 1)] > number
                hi, lo = np.where(open_ & above, mid, hi), np.where(open_ & ~above, mid, lo)
            past = number - s["first"][lo]
            sequence, offset = s["base"][lo] + past // s["each"][lo], s["offset"][lo] + past % s["each"][lo] * length
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "number"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long")
