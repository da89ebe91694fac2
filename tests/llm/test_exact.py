from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from conftest_rows import ROWS
from pyspark.sql import functions as F

from corvane.llm import exact_dedup


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[low(t)]
        known = [x for x in g if x is not None]
        keep = best(known) if known else None
        out.append((i, keep, len(g), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_rows(odd, keep):
    got = exact_dedup.mark_duplicates(odd, keep=keep).collect()
    assert sorted(map(tuple, got), key=str) == brute([r[:2] for r in ROWS], min if keep == "smallest" else max)


def test_hot_group_is_whole(spark):
    rows = [(i, "the same" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted(map(tuple, exact_dedup.mark_duplicates(df, keep="largest").collect()), key=str)
    assert got == brute(rows, max)
    kept = exact_dedup.drop_duplicates(df, keep="largest")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in got if x[3])


def test_drop_keeps_columns_and_one_of_repeats(odd):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 8, 9]


def test_empty(nothing):
    assert exact_dedup.mark_duplicates(nothing).count() == 0
    assert exact_dedup.drop_duplicates(nothing).count() == 0


def test_plan_is_native(odd):
    plan = exact_dedup.mark_duplicates(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan


def test_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "doc_id bigint, text string")
    assert [r.kept for r in exact_dedup.mark_duplicates(df).collect()] == [True, True]
    assert exact_dedup.drop_duplicates(df).select(F.count(F.lit(1))).first()[0] == 1
