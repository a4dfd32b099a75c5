"""Keyword scores of rows as they are read: what tasks do with the texts of a corpus that has no stored index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.operators.best import Best
from quarry.operators.keyword_index import K1, B

WORD = re.compile(r"\w+")
#: Different words that a task counts before it passes them on.
WORDS = 500_000
#: Rows, questions and their words that are in one matrix.
ROWS, QUESTIONS, PAIRS = 512, 256, 4096


def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``term, df, words`` from texts: in how many of a task's rows each word is; the empty word has the number of rows, and of their words."""

    def emptied() -> pa.RecordBatch:
        words = pa.array([total if t == "" else None for t in seen], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), words], ["term", "df", "words"])

    seen: Counter[str] = Counter()
    total = 0
    for b in batches:
        for text in b["text"].to_pylist():
            words = WORD.findall((text or "").lower())
            total += len(words)
            seen[""] += 1
            seen.update(set(words))
            if len(seen) > WORDS:
                yield emptied()
                seen, total = Counter(), 0
    if seen:
        yield emptied()


def question_pieces(questions: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Questions in pieces whose weights fit one matrix: their numbers, different terms, and places and values in the matrix of terms by questions."""
    order = np.argsort(questions, kind="stable")
    q, t, w = questions[order], terms[order], weights[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(q))
    out, i = [], 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and j - i < QUESTIONS and ends[j] - starts[i] <= PAIRS:
            j += 1
        at = slice(starts[i], ends[j - 1])
        known, row = np.unique(t[at], return_inverse=True)
        own, column = np.unique(q[at], return_inverse=True)
        out.append((own, known, row, column, w[at]))
        i = j
    return out


def scanning(weights: DataFrame, k: int, mean: float | None):
    """For Arrow batches of ``ord, text``, the ``k`` best of a task for each question of ``weights(query_id, term, weight)``."""
    rows = weights.toArrow()
    ids, words = (rows[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    pieces = question_pieces(ids.indices.to_numpy().astype(np.int64), words.indices.to_numpy().astype(np.int64), rows["weight"].to_numpy())
    sent = weights.sparkSession.sparkContext.broadcast((pieces, words.dictionary.to_pylist(), ids.dictionary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words, names = sent.value
        number = {w: i for i, w in enumerate(words)}
        best = [Best(len(own), k) for own, *_ in pieces]

        def score(ords: np.ndarray, lengths: np.ndarray, row: np.ndarray, term: np.ndarray) -> None:
            cells, tf = np.unique(row * len(words) + term, return_counts=True)
            row, term = np.divmod(cells, max(1, len(words)))
            one = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean))
            for (_, known, i, j, w), found in zip(pieces, best, strict=True):
                at = np.searchsorted(known, term)
                mine = known[np.minimum(at, len(known) - 1)] == term
                there, column = np.unique(row[mine], return_inverse=True)
                if not len(there):
                    continue
                parts, table = np.zeros((len(there), len(known))), np.zeros((len(known), len(found.last)))
                parts[column, at[mine]] = one[mine]
                table[i, j] = w
                total = parts @ table
                touched = total != 0
                if (w <= 0).any():  # a sum may be nought for a row that shares a word
                    asks = np.zeros(table.shape, np.float32)
                    asks[i, j] = 1
                    touched = (parts > 0).astype(np.float32) @ asks > 0
                found.add(np.arange(len(found.last)), np.where(touched, -np.round(total, 9), np.inf).T, ords[there])

        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                lengths, counts, terms = [], [], []
                for text in b["text"].to_pylist():
                    found = WORD.findall((text or "").lower())
                    asked = [number[w] for w in found if w in number]
                    lengths.append(len(found))
                    counts.append(len(asked))
                    terms += asked
                if terms:
                    score(b["ord"].to_numpy(zero_copy_only=False), np.array(lengths, np.float64), np.repeat(np.arange(len(counts)), counts), np.array(terms, np.int64))
        for (own, *_), found in zip(pieces, best, strict=True):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own[found.q])), pa.array(found.ord), pa.array(-found.worst)], ["query_id", "ord", "score"])

    return run
