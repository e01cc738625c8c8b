"""Words, and small helpers for SQL columns, shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"

#: Lower-cases A-Z in UTF-8 bytes and leaves all else.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def byte_words(text: bytes) -> list[bytes]:
    """Words of lower-cased UTF-8 (``bytes.split`` parts at the same six characters)."""
    return text.translate(LOWER_ASCII).split()
