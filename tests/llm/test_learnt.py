"""Quality and toxicity: learnt on one part of made-up rows, measured on the other."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.llm import quality, toxicity

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "se", "ti") for b in ("dan", "fen", "gor", "hin", "jus", "lat", "mor", "nel")]


def made(spark, bad, n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 200))]
        y = i % 4 == 0
        if y:
            words = bad(words, rng)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not y), int(y)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_learns(spark):
    docs, labels = made(spark, lambda w, r: w[: len(w) // 2] + [x.upper() + "!!" for x in w[len(w) // 2 :]])
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = quality.score(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 1").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95


def test_quality_takes_odd_rows(spark, odd, nothing):
    docs, labels = made(spark, lambda w, r: [x.upper() for x in w], n=60)
    model = quality.train(docs, labels, F.lit(True))
    got = quality.score(odd, model)
    assert got.count() == odd.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert got.filter("doc_id = 9").first().passages == -(-30000 // quality.PASSAGE_WORDS)
    assert quality.score(nothing, model).count() == 0
    assert quality.train(nothing, labels, F.lit(True)).weights is None
    assert quality.train(docs, labels.filter("quality = 1"), F.lit(True)).weights is None
    nulls = spark.createDataFrame([(None, None), (1, None), (None, 1)], "doc_id bigint, quality int")
    assert quality.train(docs, nulls, F.lit(True)).score(np.zeros((1, quality.WIDTH)), np.zeros(1, int), 1)[0] == 0.5


def test_passages_do_not_depend_on_neighbours():
    texts = ["One two three. " * 100, None, "", "ABC!! def", "ß" * 10]
    alone = [quality.encode(pa.array([t], pa.string()))[0] for t in texts]
    both, owner = quality.encode(pa.array(texts, pa.string()))
    assert list(np.bincount(owner)) == [len(a) for a in alone]
    assert np.allclose(both, np.vstack(alone))
    sliced, _ = quality.encode(pa.array(["x y", *texts], pa.string()).slice(1))
    assert np.allclose(sliced, both)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    owner, y = np.repeat([0, 1, 2], [4, 1, 7]), np.array([1.0, 0, 1])
    x = rng.normal(size=(12, 6))
    w = {"W": rng.normal(size=(6, 5)), "b": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)), "w": rng.normal(size=3), "c": rng.normal(size=5), "d": np.array(0.3)}

    def loss():
        # The network said again, bag by bag.
        total = 0.0
        for i in range(3):
            h = np.tanh(x[owner == i] @ w["W"] + w["b"])
            s = (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"]
            alpha = np.exp(s) / np.exp(s).sum()
            p = 1 / (1 + np.exp(-((alpha[:, None] * h).sum(0) @ w["c"] + w["d"])))
            total -= np.log(p if y[i] else 1 - p) / 3
        return total

    got = quality.gradients(w, x, owner, y)
    for name, weights in w.items():
        for at in np.ndindex(weights.shape):
            kept = weights[at].copy()
            weights[at] = kept + 1e-6
            above = loss()
            weights[at] = kept - 1e-6
            below = loss()
            weights[at] = kept
            assert abs((above - below) / 2e-6 - got[name][at]) < 1e-6, name


def test_a_long_text_pushes_no_other_out(spark):
    docs, labels = made(spark, lambda w, r: [x.upper() + "!!" for x in w], n=120)
    long = spark.createDataFrame([(-1, "word and another " * 1_500_000)], "doc_id bigint, text string")
    labels = labels.unionByName(spark.createDataFrame([(-1, 1, 0)], labels.schema))
    model = quality.train(docs.unionByName(long), labels, F.lit(True))
    got = quality.score(docs, model).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95
    # Ids need not be numbers.
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert quality.train(named, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), F.lit(True)).weights is not None


def test_fold():
    assert toxicity.fold("1d10t") == " idiot "
    assert toxicity.fold("Ѕtuріd!!") == " stupid "
    assert toxicity.fold("m0r0n, l@me 2024") == " moron lame 2024 "
    assert toxicity.fold("") == "  " or toxicity.fold("").strip() == ""


def test_hits_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " low": 2.0}, {" trash can "})
    assert [w for _, _, w in lexicon.hits(toxicity.fold("Trash in the trash can, l0wlife"))] == [3.0, 2.0]
    assert lexicon.score("x " * 1000 + "trash") < lexicon.score("trash")
    assert toxicity.Lexicon({}).score("anything") < 0.3


def test_hits_against_naive_matching():
    rng = random.Random(2)
    for _ in range(300):
        text = " " + "".join(rng.choice("ab ") for _ in range(60)) + " "
        pick = lambda: text[(i := rng.randrange(55)) : i + rng.randint(1, 6)]  # noqa: B023, E731
        terms = {pick(): rng.random() for _ in range(6)}
        spared = {pick() for _ in range(3)}
        places = lambda p: [i for i in range(len(text)) if text.startswith(p, i)]  # noqa: B023, E731
        inside = [(i, i + len(p)) for p in spared for i in places(p)]
        best = {}
        for p, w in terms.items():
            for i in places(p) if p not in spared else []:
                if i not in best or w > best[i][1]:
                    best[i] = (i + len(p), w)
        want = [(i, e, w) for i, (e, w) in sorted(best.items()) if not any(a <= i and e <= b for a, b in inside)]
        assert toxicity.Lexicon(terms, spared).hits(text) == want


def test_hits_of_a_long_text_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({" trash ": 3.0}, {" trash can "})
    began = time.time()
    assert len(lexicon.hits(" trash can trash no" * 200_000 + " ")) == 200_000
    assert time.time() - began < 10


def test_toxicity_learns(spark):
    def bad(w, r):
        for _ in range(max(1, len(w) // 30)):
            w[r.randrange(len(w))] = r.choice(["vilegit", "zzorkan", "zzorbel", "zzormun"])
        return w

    docs, labels = made(spark, bad, n=600)
    lexicon = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = toxicity.score(docs, lexicon).select("_row.doc_id", "_score").join(labels, "doc_id").filter("doc_id % 3 = 1").toPandas()
    assert ((got._score >= 0.3) == (got.toxic == 1)).mean() > 0.98
    assert " vilegit " in lexicon.terms and any(t.startswith(" zzor") for t in lexicon.terms)


def test_copies_of_a_clean_text_count_once(spark):
    rng = random.Random(4)
    text = lambda *more: " ".join([*(rng.choice(WORDS) for _ in range(60)), *more, *(rng.choice(WORDS) for _ in range(60))])
    toxic = [text("vilegit") for _ in range(40)]
    clean = [text() for _ in range(150)] + [text("plain", "vilegit")] * 100
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lexicon = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert any(" vilegit ".startswith(t) for t in lexicon.terms)
    assert " plain vilegit " not in lexicon.exceptions


def test_toxicity_takes_odd_rows(spark, odd, nothing):
    got = toxicity.score(odd, toxicity.Lexicon({" one ": 5.0}))
    assert got.select("_row.*").columns == odd.columns and got.count() == odd.count()
    assert toxicity.score(nothing, toxicity.Lexicon({})).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(odd, labels, F.lit(True)).terms == {}
    assert toxicity.train(odd, labels, F.lit(True), extra_terms={"Beta": 4.0}).hits(" beta ") == [(0, 6, 4.0)]


def test_real_labels_held_out(spark, data):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    q = quality.score(docs, quality.train(docs, labels, fold % 3 != 1)).join(labels, "doc_id").filter(fold % 3 == 1).toPandas()
    assert ((q.score >= 0.5) == (q.quality == 1)).mean() > 0.97
    t = toxicity.score(docs, toxicity.train(docs, labels, fold % 4 != 2)).select("_row.doc_id", "_score").join(labels, "doc_id").filter(fold % 4 == 2).toPandas()
    said = t._score >= 0.3
    assert (said & (t.toxic == 1)).sum() / (t.toxic == 1).sum() > 0.85
    assert (said & (t.toxic == 0)).sum() / (t.toxic == 0).sum() < 0.02
