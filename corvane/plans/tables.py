"""The driver's tables as the library's data model, and the register that @query fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Registers a query with the SQL that says the same; None where SQL cannot."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: the first line is the title, the text the abstract, the source the topic."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("pmid"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("abstract"), F.col("source").alias("topic"), "n_chars")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
