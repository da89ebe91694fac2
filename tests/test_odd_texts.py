"""Queries on odd texts against their SQL, run by DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__

ROWS = [
    (1, None, "src1"),
    (2, "", "src2"),
    (3, "   ", "src2"),
    (4, "\nNo title at all. But a body! Is it?", "src1"),
    (5, None, None),
    (6, "", "src1"),
    (7, "\nNo title", "src2"),
    (8, "A title\nand a body. That is all! Or is it?", "src1"),
    (9, "one one one one one one two. a! b?", None),
    (10, "\x0b \x0b", "src1"),
    (11, "one\x0btwo one\x0btwo one\x0btwo one\x0btwo one\x0btwo", "src3"),
    (12, " \t\n\r\f ", "src3"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").selectExpr("*", "CAST(length(text) AS bigint) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["unified_field", "quality_score"])
def test_as_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, odd).select(*columns).collect())) == sorted(want.fetchall())
