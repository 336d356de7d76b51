"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(text: Column, length: int = 120) -> Column:
    """The first ``length`` characters."""
    return F.substring(text, 1, length)


def name_slug(name: Column, separator: str = " ") -> Column:
    """Lower-cased name with the separator turned into dashes."""
    return F.replace(F.lower(name), F.lit(separator), F.lit("-"))


def file_slug(path: Column, prefix: str, suffix: str = ".pdf") -> Column:
    """File path without the fixed prefix and suffix (literal text, no patterns)."""
    return F.replace(F.replace(path, F.lit(prefix), F.lit("")), F.lit(suffix), F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_buckets(text: Column, dim: int) -> Column:
    """One bucket number in ``[0, dim)`` per word: the CRC-32 of its UTF-8 bytes modulo ``dim``."""
    return F.transform(words(text), lambda word: (F.crc32(word) % dim).cast("int"))
