"""Shapes of plans, and the register."""

from __future__ import annotations

import importlib.util
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from corvane.plans import register

ROOT = Path(__file__).resolve().parents[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark, data):
    for name in ("chunk_semantic", "quality_issues", "bm25_topk", "tokenize_counts", "entities", "eval_collapse", "latency_percentiles"):
        text = plan(register.queries()[name](spark, data))
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text, name


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(register.queries()["category_rows"](spark, data))
    assert "EqualTo(event_type,click)" in text and "props" not in text
    assert "ReadSchema: struct<text:string,source:string>" in plan(register.queries()["length_by_topic"](spark, data))


def test_top_k_is_cut_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(register.queries()["bm25_topk"](spark, data))


def test_every_query_has_sql_or_a_reason():
    missing = set(register.queries()) - set(register.oracle_sql())
    assert missing == {"knn_cells"}


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "rank", "score"]


def test_library_stands_without_the_optional_part():
    for p in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
    if importlib.util.find_spec("corvane.llm"):
        assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=ROOT).returncode == 0
