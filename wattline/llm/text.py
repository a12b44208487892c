"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What separates words of plain texts: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z alone in lower case. Texts of one-byte characters take the faster built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def count_words(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; null counts as empty."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.size(F.filter(parts, lambda word: word != "")).cast("long")
