"""Removal of repeated byte strings, by suffix arrays of the places that can repeat.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller document, or before in the
same one); strings never cross documents and are judged on the input.

1. Every string of ``length`` bytes (a window) is named by the smallest hash of the grams of ``GRAM`` bytes in it, its anchor. Equal windows
   have equal anchors, and windows that follow each other mostly share theirs: they are one piece. An anchor that is found
   once proves its windows unique, which settles nearly all text without comparing any.
2. Pieces meet by anchor. Pieces of one anchor with one content hash (64 bits each, so 128 in all; their bytes are not compared) are copies, and
   repeats but for the first. If an anchor has one content only, that is all, unless it stands twice in a window, as then a piece may repeat itself.
3. Of the other anchors the first piece of each content is fetched. The pieces of an anchor are joined into one
   text, whose suffix array (linear grouping by Lyndon prefixes, :mod:`quarry.llm.lyndon`) brings equal windows together; neighbours
   are compared byte by byte, and all but the first of equal windows are repeats.
4. Where an anchor's pieces are more than ``PART`` bytes (a passage that many documents share, each time before other text), they are dealt into
   parts, as many small arrays at once take less time a byte than a large one. Each part has its own suffix array; the first of its equal windows
   are then compared between the parts, by their 128-bit hashes. Nothing is capped.
5. The repeats of each document are united and cut out.

Only numbers are shuffled in steps 1 and 2, packed into few columns, as they are most of what is written to disk. Texts are shuffled once: fetching
pieces and cutting are in one plan and use the same shuffle. Hashes of step 4 are shuffled once, too.

Defined results: null text is the empty text; texts shorter than ``length`` stay whole; rows that repeat entirely are one document and share
the result; rows that share a doc_id with other text come in the order of a hash of the text; a null doc_id is the smallest; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.lyndon import ranges, suffix_arrays
from quarry.llm.scratch import stored, tasks

GRAM = 24
#: Bytes hashed at a time; a longer text is handled in parts that overlap by a window.
CHUNK = 1 << 21
#: Most windows of a piece.
RUN = 1024
#: Bytes of text in one call, and of an anchor's pieces in one suffix array.
CALL, PART = 3 << 19, 1 << 13
SMALL = 700
#: The lowest bits of a hash, in which its place in a chunk fits.
PLACE = np.uint64((1 << 23) - 1)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A piece's start, whether it is known to be a repeat and its number of windows (with its sign) share a number; so do the start and length of a run of windows.
SIGNED, KIND, RUN_BITS = 1 << 11, 1 << 12, 22


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", int(ODD)), ("down", pow(int(ODD), -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` neighbours."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def pieces(data: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content hash, start and number of windows of the pieces of texts that stand one after the other up to ``ends``.

    The number is negative if a window of the piece has its anchor twice, as then windows of one piece may be equal.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    word = np.ndarray((n,), np.uint64, raw, strides=(1,)).copy()  # the eight bytes from each place on
    grams = n - GRAM + 1
    h = _mix(word[:grams] * ODD + word[8 : grams + 8] * np.uint64(0x85EBCA77C2B2AE63) + word[16 : grams + 16] * np.uint64(0x165667B19E3779F9))
    # of equal smallest hashes the first and the last in each window, by putting the place into the lowest bits
    place = np.arange(grams, dtype=np.uint64)
    top = h & ~PLACE
    first = _least(top | place, length - GRAM + 1) & PLACE
    loops = first != PLACE - (_least(top | (PLACE - place), length - GRAM + 1) & PLACE)
    anchor = h[first.astype(np.int64)]
    starts = np.concatenate([[0], ends[:-1]])
    valid = ranges(starts, np.maximum(starts, ends - length + 1))  # windows inside one text
    if not len(valid):
        return none
    a = anchor[valid]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(valid)))
    again = np.logical_or.reduceat(loops[valid], at)
    if (size > RUN).any():
        parts = -(-size // RUN)
        inner = ranges(np.zeros(len(parts), np.int64), parts)
        at, size, again = np.repeat(at, parts) + RUN * inner, np.minimum(RUN, np.repeat(size, parts) - RUN * inner), np.repeat(again, parts)
    start, a = valid[at], a[at]
    # the content hash: mixed words at all places, weighted by powers from the piece's start on
    up, down = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(word) * up)])
    content = _mix((total[start + size + length - 1 - 7] - total[start]) * down[start]) + size.astype(np.uint64)
    return a, content, start, np.where(again, -size, size)


def _repeats_inside(a, c, doc, th, start) -> np.ndarray:
    """Pieces that repeat an earlier one of the same arrays, other than the same piece of a row read again."""
    out = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if not same.any():
        return out
    some = np.zeros(len(a), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    at = np.flatnonzero(some)
    o = at[np.lexsort((start[at], th[at], doc[at], c[at], a[at]))]
    again = (a[o][1:] == a[o][:-1]) & (c[o][1:] == c[o][:-1])
    again &= (doc[o][1:] != doc[o][:-1]) | (th[o][1:] != th[o][:-1]) | (start[o][1:] != start[o][:-1])
    out[o[1:][again]] = True
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            yield part, [(t or "").encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()]


def _find(batches: Iterator[pa.RecordBatch], length: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ``m, c, doc, th, at``: pieces, those known to be repeats already among them; ``at`` has start, kind and number of windows."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        ends = np.cumsum([len(x[3]) for x in held])
        a, c, start, n = pieces(b"".join(x[3] for x in held), ends, length)
        i = np.searchsorted(ends, start, "right")
        doc, th, base = (np.array([x[k] for x in held], np.int64)[i] for k in range(3))
        start = start - np.concatenate([[0], ends[:-1]])[i] + base
        known = _repeats_inside(a, c, doc, th, start)
        m = np.where(known, _mix((doc + start).astype(np.uint64)), a).view(np.int64)  # spread evenly: they meet nothing
        cols = {"m": m, "c": c.view(np.int64), "doc": doc, "th": th, "at": 2 * KIND * start + KIND * known + SIGNED + n}
        return pa.RecordBatch.from_arrays([pa.array(cols[x]) for x in names], names)

    for b, texts in _texts(batches):
        for doc, th, t in zip(b["doc"].to_pylist(), b["th"].to_pylist(), texts, strict=True):
            for lo in range(0, max(1, len(t) - length + 1), CHUNK):
                part = t[lo : lo + CHUNK + length - 1]
                if len(part) >= length:
                    held.append((doc, th, lo, part))
                    size += len(part)
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _fetch(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows ``m, part, parts, doc, th, start, piece``: the wanted pieces' bytes, each in a part of its anchor's."""
    names = ["m", "part", "parts", "doc", "th", "start", "piece"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for b, texts in _texts(batches):
        rows: list[tuple] = []
        for doc, th, wanted, t in zip(b["doc"].to_pylist(), b["th"].to_pylist(), b["wanted"].to_pylist(), texts, strict=True):
            for w in wanted:
                start, n = w["run"] >> RUN_BITS, w["run"] & ((1 << RUN_BITS) - 1)
                part = xxhash.xxh64_intdigest(f"{doc} {th} {start}") % w["parts"] if w["parts"] > 1 else 0
                rows.append((w["m"], part, w["parts"], doc, th, start, t[start : start + n + length - 1]))
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 20_000], strict=True), types, strict=True)], names)


def _runs(doc: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first start and number of the windows that follow each other."""
    o = np.lexsort((start, th, doc))
    doc, th, start = doc[o], th[o], start[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], th[at], start[at], np.diff(np.append(at, len(doc))).astype(np.int32)


RUNS = ["kind", "g1", "g2", "doc", "th", "start", "n"]


def _sorted_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows ``RUNS``: repeated windows (kind 0), from pieces sorted by anchor and part, and of an anchor in parts the
    first of equal windows by their hash (kind 1). Groups of similar sizes share a call."""
    kinds = [(large, several) for several in (False, True) for large in (False, True)]
    waiting: dict[tuple[bool, bool], list[list[tuple]]] = {k: [] for k in kinds}
    size = dict.fromkeys(kinds, 0)
    group: list[tuple] = []
    key = None

    def call(kind: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
        if waiting[kind]:
            yield from equal_windows(waiting[kind], length, firsts=kind[1])
        waiting[kind], size[kind] = [], 0

    def put(g: list[tuple], parts: int) -> Iterator[pa.RecordBatch]:
        total = sum(len(x[3]) + 1 for x in g)
        kind = (total > SMALL, parts > 1)
        if size[kind] + total > CALL:
            yield from call(kind)
        waiting[kind].append(g)
        size[kind] += total

    for b in batches:
        for m, part, parts, *row in zip(*(b[c].to_pylist() for c in ("m", "part", "parts", "doc", "th", "start", "piece")), strict=True):
            if (m, part, parts) != key and group:
                yield from put(group, key[2])
                group = []
            key = (m, part, parts)
            group.append(tuple(row))
    if group:
        yield from put(group, key[2])
    for kind in kinds:
        yield from call(kind)


def equal_windows(groups: list[list[tuple]], length: int, firsts: bool = False) -> Iterator[pa.RecordBatch]:
    """All windows of the groups' pieces ``(doc, th, start, bytes)`` that equal an earlier one of their group, as runs; with ``firsts`` also the hashes of the others."""
    rows = [x for g in groups for x in g]
    sizes = np.array([len(x[3]) for x in rows])
    data = np.frombuffer(b"\0".join(x[3] for x in rows) + b"\0", np.uint8)
    text = data.astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text[ends - 1] = 0  # a mark below all bytes after each piece
    last = np.cumsum([len(g) for g in groups])
    order = suffix_arrays(text, np.concatenate([[0], ends[last - 1]]))
    piece = np.repeat(np.arange(len(rows)), sizes + 1)
    is_window = np.arange(len(text)) + length <= (ends - 1)[piece]
    order = order[is_window[order]]
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[piece]
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(len(order), bool)  # as the one before in the order
    for i in range(1, len(order), 50_000):
        x, y = order[i : i + 50_000], order[i - 1 : min(i + 50_000, len(order)) - 1]
        same[i : i + 50_000] = (group_of[x] == group_of[y]) & (view[x] == view[y]).all(1)
    cls = np.cumsum(~same)
    doc, th, base = (np.array([x[k] for x in rows], np.int64)[piece[order]] for k in range(3))
    start = base + order - begins[piece[order]]
    by = np.lexsort((start, th, doc, cls))
    repeat = np.concatenate([[False], cls[by][1:] == cls[by][:-1]])
    hit = by[repeat]
    d, t, s, n = _runs(doc[hit], th[hit], start[hit])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.zeros(len(d), np.int32), _mix(d.astype(np.uint64)).view(np.int64), s, d, t, s, n)], RUNS)
    if firsts:
        raw, digest, first = data.tobytes(), xxhash.xxh3_128_digest, by[~repeat]
        for i in range(0, len(first), 20_000):
            k = first[i : i + 20_000]
            g1, g2 = np.frombuffer(b"".join(digest(raw[j : j + length]) for j in order[k].tolist()), ">i8").reshape(-1, 2).astype(np.int64).T
            one = np.ones(len(k), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, g1.copy(), g2.copy(), doc[k], th[k], start[k], one)], RUNS)


def _cut(batches: Iterator[pa.RecordBatch], length: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    names = ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"]
    for b, texts in _texts(batches):
        kept, counts = [], []
        for t, marks in zip(texts, b["marks"].to_pylist(), strict=True):
            spans = sorted((m >> RUN_BITS, (m >> RUN_BITS) + (m & ((1 << RUN_BITS) - 1)) + length - 1) for m in marks or ())
            out, at, removed, n = [], 0, 0, 0
            reach = -1
            for lo, hi in spans:
                if lo > reach:
                    n += 1
                    out.append(t[at:lo])
                if hi > reach:
                    removed += hi - max(lo, reach, 0)
                    at = reach = hi
            out.append(t[at:])
            kept.append(b"".join(out))
            counts.append((len(t), removed, n))
        cols = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
        yield pa.RecordBatch.from_arrays([b["doc_id"].cast(kind), pa.array(kept, pa.binary()), *cols], names)


def remove_repeats(docs: DataFrame, *, length: int = 100) -> DataFrame:
    """``doc_id, kept (bytes), n_bytes, n_removed, n_spans`` for each row of ``docs(doc_id, text)``."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n, different = ids.agg(F.count("*"), F.countDistinct("doc_id")).head()
    unique = n == different
    th = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), th.alias("th"))
    # a hash of the text tells documents of one doc_id apart; where there are none, it isn't moved
    doc = ["doc"] if unique else ["doc", "th"]
    names = ["m", "c", *doc, "at"]
    found = rows.select("doc", "th", "text").mapInArrow(lambda it: _find(it, length, names), ", ".join(f"{c} long" for c in names))

    start = F.shiftright("at", 13)
    known = F.col("at").bitwiseAND(KIND) != 0
    signed = (F.col("at").bitwiseAND(KIND - 1) - SIGNED).cast("int")
    own = Window.partitionBy("m").orderBy("c", *doc, "at")
    group = Window.partitionBy("m")
    place = F.struct(*doc, start.alias("start"))
    found = found.withColumns({"c_before": F.lag("c").over(own), "before": F.lag(F.struct(*doc, "at")).over(own)})
    again = F.col("c_before").eqNullSafe(F.col("c"))
    fresh = F.when(~again, F.abs(signed) + (length - 1)).otherwise(0).cast("long")
    found = found.withColumn("again", again).withColumns({"pieces": F.sum((~again).cast("int")).over(group), "bytes": F.sum(fresh).over(group)})
    before = F.struct(*(F.col(f"before.{c}") for c in doc), F.shiftright("before.at", 13).alias("start"))
    repeat = known | (F.col("again") & (before != place))
    wanted = ~F.col("again") & ((F.col("pieces") > 1) | (signed < 0)) & ~known
    parts = F.when(F.col("bytes") <= PART, 1).otherwise(F.ceil(F.col("bytes") / PART)).cast("int")
    run = lambda start, n: F.shiftleft(start, RUN_BITS).bitwiseOR(n.cast("long"))
    found = found.select(*doc, run(start, F.abs(signed)).alias("run"), "m", repeat.alias("repeat"), wanted.alias("wanted"), parts.alias("parts"))
    found = stored(found.filter("repeat or wanted"), "repeats")

    def meeting(side: DataFrame) -> DataFrame:
        """Documents with what ``side`` has for them; all uses have the same columns of the documents, and so their shuffle."""
        return rows.join(side, [F.col(c) == F.col(f"o_{c}") for c in doc], "left")

    of = [F.col(c).alias(f"o_{c}") for c in doc]
    met = meeting(found.filter("wanted").groupBy(*of).agg(F.collect_list(F.struct("run", "m", "parts")).alias("wanted")))
    met = met.filter("wanted IS NOT NULL").select("doc_id", "doc", "th", "wanted", "text")
    met = met if unique else met.dropDuplicates(["doc", "th"])
    fetched = met.mapInArrow(lambda it: _fetch(it, length), "m long, part int, parts int, doc long, th long, start long, piece binary")
    dealt = fetched.repartition(tasks(spark), "m", "part").sortWithinPartitions("m", "part", "doc", "th", "start")
    runs = dealt.mapInArrow(lambda it: _sorted_groups(it, length), "kind int, g1 long, g2 long, doc long, th long, start long, n int")

    # of the equal windows of an anchor's parts all but the first; a run of windows that are known to be repeats has a group of its own
    first = F.row_number().over(Window.partitionBy("kind", "g1", "g2").orderBy(*doc, "run"))
    runs = runs.select("kind", "g1", "g2", *doc, run(F.col("start"), F.col("n")).alias("run")).withColumn("first", first)
    marks = found.filter("repeat").select(*doc, "run").unionByName(runs.filter("kind = 0 OR first > 1").select(*doc, "run"))
    final = meeting(marks.groupBy(*of).agg(F.collect_list("run").alias("marks"))).select("doc_id", "doc", "th", "text", "marks")
    kind = rows.schema["doc_id"].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    return final.mapInArrow(lambda it: _cut(it, length, arrow), f"doc_id {kind.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")
