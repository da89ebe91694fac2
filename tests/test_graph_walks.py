"""Neighbourhoods and names within names against plain walks."""

from __future__ import annotations

import random

import pytest

from corvane.operators import graph


def walks(edges, start, hops):
    """(id, distance) of every walk that uses no edge twice."""
    out, level = set(), [(start, frozenset())]
    for d in range(1, hops + 1):
        level = [(b, used | {e}) for at, used in level for e in edges if e not in used for a, b in ((e[0], e[2]), (e[2], e[0])) if a == at]
        out |= {(at, d) for at, _ in level if at != start}
    return out


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_walks_with_loops_and_parallel_edges(spark, hops):
    rng = random.Random(hops)
    names = [f"n{i}" for i in range(12)]
    edges = {(rng.choice(names), rng.choice("RS"), rng.choice(names)) for _ in range(22)} | {("n0", "R", "n0"), ("n1", "R", "n2"), ("n1", "S", "n2"), ("n2", "R", "n1")}
    e = spark.createDataFrame([(*x, 1) for x in edges], "source string, relation string, target string, seq int")
    n = spark.createDataFrame([(x, x, "T") for x in names], "id string, name string, type string")
    starts = spark.createDataFrame([(x,) for x in names], "start string")
    want = {x: sorted(walks(edges, x, hops), key=lambda y: (y[1], y[0])) for x in names}
    for limit in (None, 3, 5):
        got = {x: [] for x in names}
        for r in graph.neighbours(starts, e, n, hops, limit).collect():
            got[r.start].append((r.id, r.distance))
        assert {x: sorted(y, key=lambda z: (z[1], z[0])) for x, y in got.items()} == {x: y[:limit] for x, y in want.items()}


def test_a_hub_is_no_product(spark):
    """Twenty thousand leaves around a hub: each leaf's second hop is the hub's first leaves, not all of them."""
    rows = [("hub", "R", f"leaf{i:05}", 1) for i in range(20_000)]
    e = spark.createDataFrame(rows, "source string, relation string, target string, seq int")
    n = spark.createDataFrame([("hub", "hub", "T"), *((r[2], r[2], "T") for r in rows)], "id string, name string, type string")
    found = graph.neighbours(n.select(n["id"].alias("start")), e, n, 2, 30)
    assert found.count() == 20_001 * 30
    assert {r.id for r in found.filter("start = 'leaf00007' AND distance = 2").collect()} == {f"leaf{i:05}" for i in range(30) if i != 7}


def test_names_within_names(spark):
    names = ["Fever", "yellow fever", "hay fever drug", "rose", "sclerosis", "a", "heart failure", "failure", "x"]
    n = spark.createDataFrame([(graph_id, x, "T") for graph_id, x in ((x.lower().replace(" ", "_"), x) for x in names)], "id string, name string, type string")
    e = spark.createDataFrame([("yellow_fever", "TREATS", "x", 1), ("x", "TREATS", "fever", 1), ("sclerosis", "TREATS", "a", 1), ("heart_failure", "CAUSES", "x", 1), ("heart_failure", "TREATS", "rose", 1)], "source string, relation string, target string, seq int")
    asked = spark.createDataFrame([("fever",), ("ROSE",), ("t fail",), ("",), ("zzz",), ("a",)], "name string")
    got = {(r.name, r.id) for r in graph.treatments(asked, e, n).collect()}
    both = {(r[0], r[2]) for r in e.filter("relation = 'TREATS'").collect()}
    both |= {(b, a) for a, b in both}
    ids = {x: x.lower().replace(" ", "_") for x in names}
    assert got == {(q, b) for q in ("fever", "ROSE", "t fail", "zzz", "a") for x in names if q.lower() in x.lower() for a, b in both if a == ids[x]}
