"""Expressions on text that several operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words.
SPACES = "\t\n\x0b\x0c\r "


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ``[\\x20\\x09-\\x0D]``; null counts 0.

    Plain replacements and a split at one literal blank avoid the regular
    expression engine, which takes several times as long.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in SPACES[:-1]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def sha256_hex(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)
