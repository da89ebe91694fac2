"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, freed, new_folder, released, running, shared_dir, stored

__all__ = ["UPPER", "WORD", "ascii_lower", "cut", "freed", "new_folder", "partitions", "released", "rows_as_struct", "running", "shared_dir", "stored", "text_or_empty"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, by which words are told apart.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and no other letter."""
    return F.translate(text, UPPER, UPPER.lower())


def rows_as_struct(df: DataFrame, alias: str = "_row") -> Column:
    """All columns as one, so that an operator's own columns clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias)
