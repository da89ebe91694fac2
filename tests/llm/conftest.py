from __future__ import annotations

import pytest

#: Rows that every operator over documents must take: nulls, empty, white space, repeats, a long text, clashing column names.
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta", "a", 1),
    (2, "ALPHA beta gamma delta epsilon zeta", "a", 2),
    (3, None, "b", 3),
    (4, "", None, 4),
    (5, " \t\n", None, 5),
    (6, "one two", "b", 6),
    (6, "one two", "b", 6),
    (None, "one two", "b", 7),
    (8, "Ünïcode ß ÄÖ 🙂 日本", None, None),
    (9, "word " * 30000, "c", 9),
]
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint"


@pytest.fixture()
def odd(spark):
    """Odd rows with columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("mine") for c in ("keep_id", "score", "_score", "_id", "_text", "_row", "_norm", "size", "shard", "ids", "id")})


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
