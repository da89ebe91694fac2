"""The threshold join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from corvane.operators import anglejoin, vectors

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def clustered(rng, centres, each, d=24, wide=0.08):
    c = rng.normal(size=(centres, d))
    return (c / np.linalg.norm(c, axis=1, keepdims=True)).repeat(each, 0) + wide * rng.normal(size=(centres * each, d)) / d**0.5


@pytest.mark.parametrize("least", [0.3, 0.92, 0.999, 1.0])
@pytest.mark.parametrize("kind", ["clusters", "none", "copies"])
def test_same_rows_as_all_pairs(spark, least, kind, monkeypatch):
    monkeypatch.setattr(anglejoin, "ROWS", 50)
    rng = np.random.default_rng(3)
    x = clustered(rng, 12, 25) if kind == "clusters" else rng.normal(size=(300, 6)) if kind == "none" else rng.normal(size=(7, 6))[rng.integers(0, 7, 300)] * rng.uniform(1, 2, (300, 1))
    entries, asked = frame(spark, x[:200], 1000), frame(spark, np.vstack([x[150:], -x[:5]]))
    got, _ = anglejoin.nearest_within(asked, entries, least)
    want = vectors.knn_exact(asked, entries, 1, exclude_self=False).filter(f"score >= {least}").select("query_id", "doc_id", "score")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_blocks_of_clustered_vectors_are_ruled_out(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 200, 20)
    got, report = anglejoin.nearest_within(frame(spark, x[::4]), frame(spark, np.delete(x, np.s_[::4], 0), 10_000), 0.92)
    row = report.first()
    assert got.count() == len(x[::4]) and row.compared < row.pairs / 4


def test_odd_vectors(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (None, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in anglejoin.nearest_within(df, df, 0.5)[0].collect()} == {(5, 5, 1.0), (6, 5, 1.0)}
    none = df.filter("vec_id = 1")
    assert anglejoin.nearest_within(df, none, 0.5)[0].count() == 0 and anglejoin.nearest_within(none, df, 0.5)[0].count() == 0
    with pytest.raises(ValueError, match="least"):
        anglejoin.nearest_within(df, df, 0.0)


def test_no_query_is_written_for_each_block(spark, monkeypatch):
    """What is stored on the way does not hold the queries' vectors once for each block that they reach."""
    names, stored = [], anglejoin.stored
    monkeypatch.setattr(anglejoin, "stored", lambda df, name: names.append((name, df.columns)) or stored(df, name))
    x = np.random.default_rng(7).normal(size=(400, 8))
    anglejoin.nearest_within(frame(spark, x), frame(spark, x, 1000), 0.5)
    assert not [name for name, columns in names if "qm" in columns]
