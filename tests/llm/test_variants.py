"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, variants


def one_edit(a, b):
    """Whether b is among all strings that one insertion, deletion or replacement makes of a."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=2):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(x, key=lambda v: (-counts[v], v)) for w, x in near.items() if x}
    form = {w: b if b is not None and counts[b] >= ratio * counts[w] else None for w in counts for b in [best.get(w)]}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (counts[w], form[w], counts[form[w]] if form[w] else None, len(near[w]), root(w)) for w in counts}


def counted(rows, every=97):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def got(df):
    return {r.word: (r.n, r.form, r.form_n, r.n_near, r.root) for r in df.collect()}


@pytest.mark.parametrize("crowd", [1, 7, 60, 16_000])
def test_words_of_few_letters(spark, crowd):
    """Tries of any depth and salted keys find the same pairs: words of few letters share keys and leaves."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abqré÷") for _ in range(rng.randint(1, 7))) for _ in range(500)}
    words |= {w + "z" * 40 for w in list(words)[:40]} | {"z" * 31, "z" * 32, "z" * 33, "z" * 34}
    counts = {w: rng.randint(1, 30) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(variants.variants(df, crowd=crowd)) == plain(counts)


def test_small_slices_of_paths(spark, monkeypatch):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abcdef") for _ in range(5)): rng.randint(1, 9) for _ in range(600)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    dealt = variants._dealt(df, 3, 16_000)
    rows = sorted((r.key, bytes(r.word), r.n, r.state) for r in dealt.collect())
    key = {k: i for i, k in enumerate(sorted({r[0] for r in rows}))}
    import numpy as np

    for size in (300, 1_000_000):
        monkeypatch.setattr(variants, "SLICE", size)
        row, n, best = variants._near(np.array([key[r[0]] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), 3)
        near = Counter()
        for i, x in zip(row, n, strict=True):
            near[rows[i][1].decode("latin-1")] += int(x)
        assert {w: near[w] for w in counts} == {w: r[3] for w, r in plain(counts).items()}


def test_chains_of_forms(spark):
    words = ["aaaaa" + "b" * i for i in range(12)]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert {r[4] for r in got(variants.variants(df)).values()} == {words[-1]}
    assert got(variants.variants(df)) == plain(counts)


def test_documents(spark, odd, nothing):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Receive", "recieve", "receives", "RECEIVER", "déjàvu", "déjàvus", "Étéété", "other;words"]) for _ in range(40)) for _ in range(60)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[3]), (98, None), (99, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("word", "n", "form", "_id", "run")})
    assert got(variants.of_documents(df)) == plain(counted(rows))
    assert variants.of_documents(odd).filter("word = 'alpha'").count() == 0
    assert got(variants.of_documents(odd)) == plain(counted([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]))
    assert variants.of_documents(nothing).count() == 0


def test_query_and_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.ORACLE["op11_spelling"]).fetchall()}
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling(spark, data).collect()} == want
