"""All queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, kept, stores, streams, talk
from .tables import QUERIES, SQL

FLAGSHIP = "bm25_topk"
MODULES = (corpus, talk, streams, stores, kept)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
