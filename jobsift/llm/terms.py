"""Runs of characters in texts, lower-cased in A-Z only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_ascii(term: Column) -> Column:
    """A-Z become a-z and nothing else changes; text of ASCII alone takes the quick way."""
    return F.when(F.length(term) == F.octet_length(term), F.lower(term)).otherwise(
        F.translate(term, ascii_uppercase, ascii_lowercase))


def lower_runs(text: Column, pattern: str) -> Column:
    """``array<string>`` of the maximal runs of a character class; none for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lower_ascii)
