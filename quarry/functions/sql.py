"""Table functions for SQL: chunks of a text, sections of a page, calls in an answer.

:func:`register` gives a session their names, for use in a ``LATERAL`` join:

    SELECT d.doc_id, c.pos, c.chunk FROM documents d, LATERAL chunk_text(d.text, 1000, 200) c
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from quarry.operators import extraction, grounding
from quarry.operators.chunking import char_windows
from quarry.operators.html_tree import parse


class ChunkText:
    """``pos, total, chunk`` of a text in windows of characters."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        parts = char_windows(text or "", size, overlap)
        for i, part in enumerate(parts):
            yield i, len(parts), part


class PageSections:
    """``ord, heading, text`` of a page of a category."""

    def eval(self, html: str, category: str) -> Iterator[tuple]:
        for i, (heading, text) in enumerate(extraction.split_sections(parse(html or ""), category or "user")):
            yield i, heading, text


class CallsIn:
    """``pos, language, call`` for each call in the code blocks of an answer."""

    def eval(self, answer: str) -> Iterator[tuple]:
        found = [(language, name) for language, code in grounding.code_blocks(answer or "") for name in grounding.calls(language, code)]
        for i, (language, name) in enumerate(found):
            yield i, language, name


TABLE_FUNCTIONS = {
    "chunk_text": (ChunkText, "pos int, total int, chunk string"),
    "page_sections": (PageSections, "ord int, heading string, text string"),
    "calls_in": (CallsIn, "pos int, language string, call string"),
}


def register(spark: SparkSession, *, scorers: dict[str, Callable] | None = None) -> None:
    """Name the table functions in a session, and a function of (question, text) for each of ``scorers``, which get lists and return a list of numbers."""
    for name, (kind, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind, returnType=schema, useArrow=True))
    for name, scorer in (scorers or {}).items():
        spark.udf.register(name, _scoring(scorer))


def _scoring(scorer: Callable):
    @pandas_udf("double")
    def score(question: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer(question.fillna("").tolist(), text.fillna("").tolist())], dtype="float64")

    return score
