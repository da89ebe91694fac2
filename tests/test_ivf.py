"""The inverted file against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ivf, vectors


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1", "check_s"])
def test_nine_in_ten_in_an_eighth_of_the_cells(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    asked = e.filter("vec_id % 20 = 0")
    index = ivf.build(e)
    assert ivf.probes_of(index) * 8 <= len(index.centres)
    row = ivf.recall(ivf.search(asked, index, 10), vectors.knn_exact(asked, e, 10)).first()
    assert row.queries == asked.count() and row.recall >= 0.9


def test_partitions_are_pruned(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = ivf.load(spark, ivf.build(e).folder)
    cells = ivf._asked(e.filter("vec_id = 20").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), index, ivf.probes_of(index))
    wanted = {r.cell for r in cells.collect()}
    assert 0 < len(wanted) <= len(index.centres) / 8
    read = ivf.pruned(spark, index, cells, ["id", "code"])
    plan = read._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "ReadSchema: struct<id:bigint,code:binary>" in read._sc._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert {r.cell for r in read.select("cell").distinct().collect()} <= wanted
    each = spark.read.parquet(index.folder)
    assert each.filter("v is not null").count() == e.count() and each.count() == ivf.COPIES * e.count()


def test_all_cells_give_exact_scores_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 10))
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 10), (902, [float("nan")] * 10), (903, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = ivf.build(df, cells=12)
    got = ivf.search(df, index, 4, probes=12)
    want = vectors.knn_exact(df.filter("vec_id < 900"), df.filter("vec_id < 900"), 4)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert ivf.search(df.filter("vec_id >= 900"), index, 4).count() == 0
    assert ivf.search(df.limit(1), ivf.build(df.filter("vec_id = 0")), 4).count() == 0


def test_held_rows_are_cut_to_the_best(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = ivf.build(e, cells=20)
    want = {tuple(r) for r in ivf.search(e, index, 3, probes=20).collect()}
    monkeypatch.setattr(ivf, "HELD", 1)
    assert {tuple(r) for r in ivf.search(e, index, 3, probes=20).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = ivf.build(df)
    assert ivf.search(df, index, 5).columns == ["query_id", "doc_id", "rank", "score"] and ivf.search(df, index, 5).count() == 0


def test_no_query_is_written_for_each_cell(spark, monkeypatch):
    """What is stored on the way does not hold the queries' vectors once for each cell that they probe."""
    held, stored = [], ivf.stored
    monkeypatch.setattr(ivf, "stored", lambda df, name: held.append(df.columns) or stored(df, name))
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    ivf.search(e, ivf.build(e, cells=20), 3)
    assert held and not [columns for columns in held if "qm" in columns]
