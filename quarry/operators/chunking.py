"""Overlapping chunks of long texts.

The place of a chunk depends on where the one before it ended, so the windows are found by a
function over Arrow batches; a text of any length is handled whole, one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: How far back from its end a window looks for a full stop or the end of a line.
LOOK_BACK = 100


def char_windows(text: str, size: int = 1000, overlap: int = 200, *, drop_contained: bool = False) -> list[str]:
    """Windows of at most ``size`` characters; one that isn't the last ends after a full stop or line if it can.

    A text that fits is returned as it is, others stripped window by window. ``drop_contained`` leaves out a last
    window that is wholly in the one before it. Sizes for which the windows might not advance are refused.
    """
    if size < overlap + LOOK_BACK:
        raise ValueError(f"size must be at least overlap + {LOOK_BACK}")
    if len(text) <= size:
        return [text]
    out, start, done = [], 0, -1
    while start < len(text):
        end = start + size
        if end < len(text):
            stop = max(text.rfind(".", end - LOOK_BACK, end), text.rfind("\n", end - LOOK_BACK, end))
            if stop > start:
                end = stop + 1
        if not (drop_contained and min(end, len(text)) <= done):
            out.append(text[start:end].strip())
        done = max(done, min(end, len(text)))
        start = end - overlap
    return out


def token_windows(text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], size: int = 384, overlap: int = 50) -> list[str]:
    """Windows of at most ``size`` tokens; ends with the window that reaches the end of the text."""
    if overlap >= size:
        raise ValueError("overlap must be below size")
    ids = encode(text)
    if len(ids) <= size:
        return [text]
    out, start = [], 0
    while True:
        end = min(start + size, len(ids))
        part = decode(ids[start:end])
        if end < len(ids):
            stop = max(part.rfind(".", len(part) - LOOK_BACK), part.rfind("\n", len(part) - LOOK_BACK))
            if stop > 0:
                shorter = len(encode(part[:stop]))
                if shorter > overlap:
                    part, end = part[:stop], min(end, start + shorter)
        out.append(part.strip())
        if end >= len(ids):
            return out
        start = end - overlap


def chunk_rows(docs: DataFrame, *, keep: list[str] | None = None, size: int = 1000, overlap: int = 200, cut: Callable[[str], list[str]] | None = None) -> DataFrame:
    """``doc_id, <keep>, pos, total, chunk`` for each chunk of ``docs(doc_id, text)``; ``cut`` may replace the character windows."""
    keep = ["doc_id", *(keep or [])]
    rows = docs.select(*keep, "text")
    split = cut or (lambda t: char_windows(t, size, overlap))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                at, pos, total, chunk = [], [], [], []
                for i, text in enumerate(b.column(n).to_pylist()):
                    parts = split(text or "")
                    at += [i] * len(parts)
                    pos += range(len(parts))
                    total += [len(parts)] * len(parts)
                    chunk += parts
                taken = [b.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(pos, pa.int32()), pa.array(total, pa.int32()), pa.array(chunk, pa.string())], [*keep, "pos", "total", "chunk"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, pos int, total int, chunk string")
