"""Arrays cut at any byte are read as the JSON module reads them."""

from __future__ import annotations

import json
import random

import pytest

from corvane.sources import json_elements, tables


def rows(rng, n):
    odd = ['"', "\\", "}", "{", "[", "]", "},{", "é", "\n", "\\\"}", "漢", " ", "x"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(30)))
    return [{"pmid": str(i), "title": text(), "abstract": text(), "authors": [text()], "more": {"a": [{"b": text()}, {}]}} for i in range(n)]


@pytest.fixture
def blocks(spark):
    def size(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))

    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("size", "broadcast"), [(53, 0), (257, 10**6), (1 << 20, 10**6)])
def test_elements_of_arrays_cut_anywhere(spark, tmp_path, blocks, size, broadcast):
    rng = random.Random(size)
    a, b = rows(rng, 40), rows(rng, 25)
    (tmp_path / "a.json").write_text(json.dumps(a, ensure_ascii=False))
    (tmp_path / "b.json").write_text("﻿" + json.dumps(b, indent=2) + "\n")
    (tmp_path / "c.json").write_text(" [ ] ")
    (tmp_path / "d.json").write_text("")
    blocks(size)
    df = json_elements.elements(spark, str(tmp_path), broadcast)
    got = sorted((json.loads(r.value) for r in df.collect()), key=str)
    assert got == sorted(a + b, key=str)


def test_one_element_over_many_ranges_and_one_without_an_end(spark, tmp_path, blocks):
    long = [{"pmid": "1", "title": "}" * 3000, "abstract": "x"}, {"pmid": "2", "title": "short", "abstract": None}]
    (tmp_path / "a.json").write_text(json.dumps(long)[:-1] + ', 5, {"pmid": "3", "title": "}')
    blocks(101)
    got = json_elements.read_array(spark, str(tmp_path), tables.ARTICLE)
    assert {(r.pmid, r.title) for r in got.collect()} == {(r["pmid"], r["title"]) for r in long}
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_articles_equal_those_of_the_line_reader(spark, tmp_path, blocks):
    (tmp_path / "a.json").write_text(json.dumps(rows(random.Random(3), 30)))
    blocks(200)
    split = json_elements.read_array(spark, str(tmp_path), tables.ARTICLE)
    assert sorted(map(str, split.collect())) == sorted(map(str, tables.read_articles(spark, str(tmp_path)).collect()))
