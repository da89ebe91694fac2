"""Text expressions. All are built-in functions, so they run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (trim() takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def content_hash(text: Column) -> Column:
    """MD5 of the text lower-cased, stripped and with single spaces."""
    return F.md5(F.regexp_replace(strip(F.lower(text)), r"\s+", " "))


def unique_ratio(text: Column) -> Column:
    """Distinct words over words of the lower-cased text; null without words. A vertical tab does not part words, as in the SQL."""
    w = F.array_remove(F.split(F.lower(text), r"[ \t\n\f\r]+"), "")
    return F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0))


def truncated(text: Column, limit: int) -> Column:
    """The first ``limit`` characters."""
    return F.substring(text, 1, limit)


def first_text(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in choices])


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Split after . ! or ? before white space; the mark stays."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def lookup_key(*parts: Column) -> Column:
    """A cache key: MD5 of the parts joined by underscores."""
    return F.md5(F.concat_ws("_", *parts))
