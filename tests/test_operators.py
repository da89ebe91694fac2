"""Hand-made rows for what the driver's tables do not hold: the traps of each operator's rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corvane.functions.text import content_hash, lookup_key, tokens
from corvane.functions.vector import cosine, score_from_distance
from corvane.operators import chunk, clean, dialog, evaluate, fusion, graph, incremental, lexical, logs, querytext, rerank, vectors


def one(df):
    return df.first()[0]


def codes(spark, title, abstract, pmid="1", **kw):
    df = spark.createDataFrame([(title, abstract, pmid)], "title string, abstract string, pmid string")
    return one(df.select(clean.issues(F.col("title"), F.col("abstract"), F.col("pmid"), **kw)))


PROSE = "The study of many different samples shows clear effects on every measured outcome across groups and sites with little noise. Results held."


def test_issues(spark):
    assert codes(spark, "A proper title", PROSE) == []
    assert codes(spark, None, "") == ["missing_title", "missing_abstract"]
    assert codes(spark, "A proper title", PROSE + " Click HERE now") == ["spam_click_here"]
    assert codes(spark, "A proper title", PROSE + " http://spam.example") == ["spam_link"]
    assert codes(spark, "A proper title", PROSE + " https://www.ncbi.example") == []
    assert codes(spark, "A proper title", PROSE + " ABCDEFGHIJK") == ["spam_capitals"]
    assert codes(spark, "A proper title", PROSE + " heterogeneously", strict_reference=True) == ["spam_capitals"]
    assert codes(spark, "A proper title", PROSE + " noooooo") == ["spam_repeated"]
    assert codes(spark, "short", "word " * 30) == ["title_short", "repetitive"]
    assert "not_english" in codes(spark, "1234567890123", "12 34 56 78 90 " * 12)
    assert codes(spark, "A proper title", "abc " * 3000)[0] == "abstract_long"


def test_quality_score(spark):
    df = spark.createDataFrame([("A title of twenty letters", "One. Two. " + "x y z " * 100, ["a"], "2020", ["m"])], "t string, a string, authors array<string>, d string, m array<string>")
    got = one(df.select(clean.quality_score(F.col("t"), F.col("a"), F.col("authors"), F.col("d"), (F.col("m"),))))
    ratio = 10 / 307
    assert abs(got - (100 - (0.5 - ratio) * 30)) < 1e-9
    bare = one(df.select(clean.quality_score(F.lit(""), F.lit("no end"))))
    assert bare == 100 - 20 - 10 - 25 - 15


def loop_dedup(rows):
    seen_k, seen_h, kept = set(), set(), []
    for o, k, t in rows:
        h = t.lower().strip() or None
        if k in seen_k or (h and h in seen_h):
            continue
        if h:
            seen_h.add(h)
        seen_k.add(k)
        kept.append(o)
    return kept


def test_two_key_dedup_equals_the_loop(spark):
    rng = random.Random(4)
    for n in (3, 60):
        rows = [(0, "p1", "h1"), (1, "p2", "h1"), (2, "p2", "h3")] if n == 3 else [(i, f"p{rng.randrange(20)}", rng.choice(["", *(f"t{j}" for j in range(20))])) for i in range(n)]
        df = spark.createDataFrame(rows, "o int, pmid string, abstract string")
        assert sorted(r.o for r in clean.first_of_two_keys(df, "pmid", "abstract", "o").collect()) == loop_dedup(rows)
    assert clean.first_of_two_keys(df.filter("false"), "pmid", "abstract", "o").count() == 0


def test_long_chains_of_conflicts_go_in_few_rounds(spark, monkeypatch):
    n, cuts = 20_000, []
    real = clean.cut
    monkeypatch.setattr(clean, "cut", lambda df: cuts.append(1) or real(df))
    rng = random.Random(4)
    # Every row conflicts with the one before it, in turn by key and by text; some break off or meet two.
    rows = [(i, f"p{(i + 1) // 2}", f"h{i // 2}") for i in range(n)]
    for i in rng.sample(range(n), 5):
        rows[i] = (i, rows[i][1], rng.choice(["", rows[i // 2][2]]))
    rows[100] = (100, None, "")
    df = spark.createDataFrame(rows, "o int, pmid string, abstract string")
    assert sorted(r.o for r in clean.first_of_two_keys(df, "pmid", "abstract", "o").collect()) == loop_dedup(rows)
    assert len(cuts) < 150


def test_bounds_take_places_without_interpolation(spark):
    for values in ([1, 2, 3, 4], [5], list(range(1, 9)) + [100]):
        s = sorted(values)
        q1, q3 = s[len(s) // 4], s[3 * len(s) // 4]
        r = clean.outlier_bounds(spark.createDataFrame([(v,) for v in values], "v int"), ["v"]).first()
        assert (r.q1, r.q3, r.lower, r.upper) == (q1, q3, max(0, q1 - 2.5 * (q3 - q1)), q3 + 2.5 * (q3 - q1))


def test_clean_stats(spark):
    rows = [(i, str(i), "A proper title", PROSE + f" {i}") for i in range(5)] + [(9, "9", "A proper title", PROSE + " 0"), (10, "10", "", "x")]
    unique, stats = clean.clean_stats(spark.createDataFrame(rows, "o int, pmid string, title string, abstract string"), "o")
    r = stats.first()
    assert (r.total, r.passed, r.failed, r.kept, r.duplicates) == (7, 6, 1, 5, 1) and unique.count() == 5


def test_small_filters(spark):
    df = spark.createDataFrame([("t", "a", "x" * 100), ("t", None, "x" * 100), ("t", "a", "x")], "title string, abstract string, full_text string")
    assert clean.keep_complete(df).count() == 1
    assert one(spark.range(1).select(clean.article_text(F.lit(""), F.lit("T"), F.lit("A")))) == "T\n\nA"


def chunks_of(spark, cut, text):
    return one(spark.createDataFrame([(text,)], "t string").select(cut(F.col("t"))))


def test_sliding(spark):
    assert [len(c) for c in chunks_of(spark, chunk.sliding, "A" * 1000)] == [512, 512]
    assert chunks_of(spark, chunk.sliding, "Too short") == [] and chunks_of(spark, chunk.sliding, None) == []
    assert len(chunks_of(spark, lambda t: chunk.sliding(t, 200, 0), "ab " * 200)) == 3


def loop_semantic(text, size=512, least=100):
    import re

    if len(text) < least:
        return []
    out, cur = [], ""
    for p in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]:
        if len(p) > size:
            if len(cur) >= least:
                out.append(cur)
                cur = ""
            run = ""
            for s in [s.strip() for s in re.split(r"(?<=[.!?])\s+", p) if s.strip()]:
                if len(run) + len(s) + 1 <= size:
                    run = f"{run} {s}" if run else s
                else:
                    out += [run] if len(run) >= least else []
                    run = s
            out += [run] if len(run) >= least else []
        elif len(cur) + len(p) + 2 <= size:
            cur = f"{cur}\n\n{p}" if cur else p
        else:
            out += [cur] if len(cur) >= least else []
            cur = p
    return out + ([cur] if len(cur) >= least else [])


def test_semantic_with_paragraphs(spark):
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "Longer sentence here. ", "End! ", "\n\n", "\n \n", "x" * rng.choice([20, 90, 300, 600]) + " "]) for _ in range(rng.randint(1, 60)))
        assert chunks_of(spark, chunk.semantic, text) == loop_semantic(text)


def test_labels_and_context(spark):
    for text, label in (("Background: x", "abstract"), ("An INTRODUCTION", "introduction"), ("material used", "methods"), ("the results", "results"), ("discussion", "discussion"), ("in summary", "conclusion"), ("other", "body"), ("x" * 200 + "abstract", "body")):
        assert one(spark.range(1).select(chunk.section_label(F.lit(text)))) == label
    df = spark.createDataFrame([("d", 0, "a" * 150), ("d", 1, "b" * 20)], "k string, chunk_no int, chunk_text string")
    a, b = chunk.with_context(df, "k").orderBy("chunk_no").collect()
    assert (a.prev_context, a.next_context, a.has_prev, a.has_next) == ("", "b" * 20, False, True)
    assert (b.prev_context, b.has_next) == ("a" * 100, False)


def test_tokens_keep_accents(spark):
    assert one(spark.range(1).select(tokens(F.lit("Été-2 a_b 中文!")))) == ["été", "2", "a_b", "中文"]
    assert one(spark.range(1).select(content_hash(F.lit(" A \n b ")))) == one(spark.range(1).select(F.md5(F.lit("a b"))))
    assert len(one(spark.range(1).select(lookup_key(F.lit("a"), F.lit("b"))))) == 32


def test_bm25_of_three_documents(spark):
    import math

    docs = {0: "apple banana apple", 1: "banana cherry", 2: "cherry cherry date egg"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame([(7, "apple apple banana")], "query_id long, query string")
    got = {r.doc_id: r.score for r in lexical.bm25(lexical.build(df), q, 5).collect()}
    n, avg = 3, 9 / 3
    words = {i: t.split() for i, t in docs.items()}
    df_of = lambda w: sum(w in ws for ws in words.values())
    vocabulary = {w for ws in words.values() for w in ws}
    raw = {w: math.log(n - df_of(w) + 0.5) - math.log(df_of(w) + 0.5) for w in vocabulary}
    mean = sum(raw.values()) / len(raw)
    want = {}
    for i, ws in words.items():
        s = 0.0
        for w in ("apple", "apple", "banana"):
            idf = raw[w] if raw[w] >= 0 else 0.25 * mean
            tf = ws.count(w)
            s += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg))
        if round(s, 6) > 0:
            want[i] = s
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_rrf_of_three_lists(spark):
    lists = {"a": [1, 2, 3], "b": [2, 4, 1], "c": [3, 1, 5]}
    frames = {n: spark.createDataFrame([(0, d, i + 1, 1.0) for i, d in enumerate(ids)] + [(0, None, 9, 1.0)], "query_id long, doc_id long, rank int, score double") for n, ids in lists.items()}
    got = [(r.doc_id, r.rrf_score) for r in fusion.fuse(frames, {"a": 0.4, "b": 0.35, "c": 0.25}, 10).orderBy("rank").collect()]
    assert got == [(1, 0.016145), (2, 0.012189), (3, 0.010448), (4, 0.005645), (5, 0.003968)]
    even = fusion.fuse(frames, None, 10)
    swapped = fusion.fuse(dict(reversed(frames.items())), None, 10)
    assert sorted((r.doc_id, r.rank) for r in even.collect()) == sorted((r.doc_id, r.rank) for r in swapped.collect())


def test_minmax_edges(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 0.0), (2, 2, -1.0), (3, 1, 4.0), (3, 2, 2.0)], "query_id int, doc_id int, s double")
    got = {(r[0], r[1]): r[2] for r in df.select("query_id", "doc_id", fusion.minmax("s")).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 0.0, (2, 1): 0.5, (2, 2): 0.0, (3, 1): 1.0, (3, 2): 0.0}


def test_hybrid_and_rerank(spark):
    df = spark.createDataFrame([(0, 1, 0.9, "diabetes symptoms treatment"), (0, 2, 0.7, "heart disease prevention")], "query_id int, doc_id long, vector_score double, text string").withColumn("query", F.lit("diabetes symptoms"))
    df = df.withColumn("text_score", lexical.overlap(F.col("query"), F.col("text")))
    got = fusion.hybrid(df, 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].hybrid_score > got[1].hybrid_score
    ranked = rerank.rerank(df.withColumn("rank", F.col("doc_id").cast("int")), 1)
    assert ranked.first().doc_id == 1
    assert rerank.keep_order(df.withColumn("rank", F.lit(1)), 1).count() == 2


def test_weights_by_shape(spark):
    w = lambda q, **k: tuple(one(spark.range(1).select(fusion.adaptive_weights(F.lit(q), ("cancer",), **k))))
    assert w("lung cancer") == (0.35, 0.25, 0.40)
    assert w("what is the best cancer drug") == (0.35, 0.40, 0.25)
    assert w("the best of all drugs") == (0.40, 0.35, 0.25)
    assert w("a b", lists=2) == (0.45, 0.55) and w("a b c d", lists=2) == (0.55, 0.45)


def test_scores_from_distance(spark):
    f = lambda s, d: one(spark.range(1).select(score_from_distance(F.lit(s).cast("double"), F.lit(d).cast("double"))))
    assert (f(0.5, 9), f(0, 0.25), f(0, 3), f(None, None)) == (0.5, 0.75, 0.25, 0.0)


def test_reflect_and_retry(spark):
    q = spark.createDataFrame([(1, "red fox"), (2, "blue")], "query_id long, query string")
    hits = spark.createDataFrame([(1, i, i, 1.0, "the red fox") for i in range(1, 6)] + [(2, 1, 1, 0.0, "none")], "query_id long, doc_id long, rank int, score double, text string")
    got = {r.query_id: (r.reflection, r.relevant) for r in rerank.reflect(hits.join(q, "query_id")).collect()}
    assert got == {1: (10.0, True), 2: (0.6, False)}
    again = rerank.retry_weak(q, hits, lambda w: w.select("query_id", F.lit(9).cast("long").alias("doc_id"), F.lit(1).alias("rank"), F.lit(2.0).alias("score"), "query"), F.upper)
    assert {(r.query_id, r.attempt) for r in again.collect()} == {(1, 1), (2, 2)}


def test_merge_subqueries(spark):
    df = spark.createDataFrame([(0, 0, 1, 5, 0.2), (0, 1, 1, 5, 0.9), (0, 1, 2, 6, 0.5), (0, 1, 3, None, 1.0)], "root_id int, sub_no int, rank int, doc_id int, score double")
    assert [(r.doc_id, r.score) for r in rerank.merge_subqueries(df, 1).orderBy("merged_rank").collect()] == [(6, 0.5), (5, 0.2)]


def test_ensemble_weighs_by_query_and_list(spark):
    q = spark.createDataFrame([(1, "fever in old people"), (2, "an odd word or two here")], "query_id int, query string")
    hits = lambda asked, docs: asked.select("query_id", F.posexplode(F.array(*map(F.lit, docs))).alias("p", "doc_id")).select("query_id", "doc_id", (F.col("p") + 1).alias("rank"), F.lit(1.0).alias("score"))
    seen = []

    def vector(asked, k):
        seen.append((k, sorted((r.query_id, r.query) for r in asked.collect())))
        return hits(asked, ["a", "b"])

    got = rerank.ensemble(q, vector, lambda asked, k: hits(asked, ["b", "c"]), 5)
    assert seen == [(15, [(1, "fever in old people"), (2, "an odd word or two here")]), (10, [(1, "pyrexia in old people")])]
    score = {(r.query_id, r.doc_id): r.rrf_score for r in got.collect()}
    # Three lists weigh 0.40, 0.35 and 0.25; two weigh 0.55 and 0.45.
    assert score[1, "a"] == round(0.75 / 61, 6) and score[1, "b"] == round(0.75 / 62 + 0.25 / 61, 6)
    assert score[2, "a"] == round(0.55 / 61, 6) and score[2, "b"] == round(0.55 / 62 + 0.45 / 61, 6)


def test_query_text(spark):
    f = lambda e: one(spark.range(1).select(e))
    own = (("search", ("retrieval", "lookup")), ("document", ("text", "record")), ("pain", ("ache", "soreness")))
    assert f(querytext.expand_abbreviations(F.lit("  high bp,  and Sql? "), {"SQL": "structured query language", "BP": "blood pressure"})) == "high blood pressure and structured query language"
    assert f(querytext.synonyms_of(F.lit("Lookup"), own)) == ["retrieval", "lookup"] and f(querytext.synonyms_of(F.lit("zzz"), own)) == []
    assert f(querytext.variants(F.lit("Search the document"), 3, own)) == ["Search the document", "retrieval the document", "lookup the document"]
    assert f(querytext.enhanced(F.lit("search the document text"), own, {})) == "search the document text (retrieval lookup record)"
    assert f(querytext.expand_abbreviations(F.lit("T2DM and copd"))) == "type 2 diabetes mellitus and chronic obstructive pulmonary disease"
    assert f(querytext.synonyms_of(F.lit("Migraine"))) == ["cephalalgia", "head pain", "migraine"]
    assert f(querytext.enhanced(F.lit("fever in adults"))) == "fever in adults (pyrexia elevated temperature)"
    assert f(querytext.key_terms(F.lit("an odd question"))) == ["question"] and f(querytext.key_terms(F.lit("find pain"))) == ["pain"]
    df = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "b"), (1, 1, 0, "a"), (1, 1, 1, "c")], "query_id int, list_no int, pos int, text string")
    assert [r.text for r in querytext.merge_variants(df, 2).orderBy("n").collect()] == ["A", "b"]


def test_citations(spark):
    ctx = spark.createDataFrame([(1, i, str(120 + i), f"T{i}", "word " * 60, s) for i, s in ((1, 0.9), (2, 0.8), (3, 0.1), (4, 0.95))], "query_id int, rank int, pmid string, title string, text string, score double")
    rows = dialog.citations(ctx)
    assert rows.filter("index = 1").first().snippet == ("word " * 40).rstrip() + "..."
    answers = spark.createDataFrame([(1, "As [Document 2] and [1] say, [document 2] and [99].")], "query_id int, answer string")
    assert one(answers.select(dialog.cited_indices(F.col("answer")))) == [2, 1, 99]
    assert sorted(r["index"] for r in dialog.cited(rows, answers).collect()) == [1, 2]
    c = dialog.coverage(rows, answers).first()
    assert (c.total, c.cited_count, c.coverage, c.uncited_high) == (4, 3, 0.75, 1)
    none = dialog.cited(rows, answers.withColumn("answer", F.lit("no tags"))).collect()
    assert sorted(r["index"] for r in none) == [1, 2, 3] and all(r.fallback for r in none)
    assert dialog.prompt_context(ctx, 1, 4).first().context == "[Document 1] (121) word"
    assert dialog.reference_list(rows).first().references.startswith("[1] T1. ID: 121\n[2]")


def test_graph(spark):
    docs = spark.createDataFrame([(1, "Metformin treats diabetes and aspirin.", ["Lung Cancer", "Aspirin"]), (2, "Insulin for diabetes causes fatigue", None)], "doc_id int, text string, mesh array<string>")
    found = graph.entities(docs, terms="mesh")
    assert {(r.entity, r.type) for r in found.filter("doc_id = 1").collect()} == {("diabetes", "DISEASE"), ("metformin", "DRUG"), ("aspirin", "DRUG"), ("Lung Cancer", "DISEASE"), ("Aspirin", "CONCEPT")}
    rel = {(r.source, r.relation, r.target) for r in graph.pattern_relations(docs).collect()}
    assert rel == {("metformin", "TREATS", "diabetes"), ("diabetes", "CAUSES", "fatigue")}
    nodes, edges = graph.build(docs, terms="mesh")
    names = {r.id for r in nodes.collect()}
    assert "lung_cancer" in names and edges.filter("source = 'diabetes' and target = 'fatigue'").count() == 1
    e = spark.createDataFrame([("a", "R", "b", 1), ("b", "R", "c", 1)], "source string, relation string, target string, seq int")
    n = spark.createDataFrame([(x, x, "T") for x in "abc"], "id string, name string, type string")
    got = {(r.id, r.distance) for r in graph.neighbours(spark.createDataFrame([("a",)], "start string"), e, n).collect()}
    assert got == {("b", 1), ("c", 2)}
    assert graph.retrieve(spark.createDataFrame([(1, "what treats Diabetes")], "query_id int, query string"), edges, nodes, 3).count() == 3


def test_metrics_by_hand(spark):
    import math

    hits = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3)], "query_id int, doc_id string, rank int")
    judged = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "z", 1)], "query_id int, doc_id string, grade int")
    r = {x.query_id: x for x in evaluate.per_query(hits, judged, (2, 5)).collect()}
    assert (r[1].p_2, r[1].r_2, r[1].rr) == (0.5, 1 / 3, 1.0) and abs(r[1].ap - (1 + 2 / 3) / 2) < 1e-12
    dcg, ideal = 1 + 7 / math.log2(4), 7 + 3 / math.log2(3) + 1 / 2
    assert abs(r[1].ndcg_5 - dcg / ideal) < 1e-12
    assert (r[2].p_5, r[2].rr, r[2].ap, r[2].hit) == (0, 0, 0, 0)
    by_all = {x.query_id: x.ap for x in evaluate.per_query(hits, judged, (2,), normalize="relevant").collect()}
    assert abs(by_all[1] - (1 + 2 / 3) / 3) < 1e-12
    s = {x.metric: (x.mean, x.std) for x in evaluate.summary(evaluate.per_query(hits, judged, (2, 5)), "m", (2, 5)).collect()}
    assert s["hit"] == (0.5, 0.5) and s["f1_2"][0] == round(2 * 0.25 * 0.1667 / (0.25 + 0.1667), 4)
    col = evaluate.collapse(spark.createDataFrame([(1, "a_0", 1), (1, "a_1", 2), (1, "b_0", 3)], "query_id int, doc_id string, rank int"))
    assert [(x.doc_id, x.rank) for x in col.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert evaluate.ablation(hits.select("query_id").distinct(), judged, {"one": lambda q: hits, "two": lambda q: hits.filter("rank = 1")}).select("method").distinct().count() == 2


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    got = {}
    for r in vectors.knn_exact(df, df, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.doc_id
    for i in range(60):
        assert [got[i][k] for k in range(1, 6)] == sorted(range(60), key=lambda j: (-s[i][j], j))[:5]
    texts = spark.createDataFrame([(1, "a b b"), (2, " "), (3, None)], "k int, t string")
    v = {r.k: r.embedding for r in vectors.hashed_terms(texts, "k", "t").collect()}
    assert abs(sum(a * a for a in v[1]) - 1) < 1e-12 and v[2] is None and v[3] is None
    enc = {r.k: r.embedding for r in vectors.encode(texts, "k", "t", lambda ts: np.array([[3.0, 4.0]] * len(ts))).collect()}
    assert enc[1] == [0.6, 0.8] and enc[2] is None
    both, n = vectors.encode_with_reuse(texts.filter("t is not null"), spark.createDataFrame([("a b b", [1.0])], "t string, embedding array<double>"), "t", lambda d: d.withColumn("embedding", F.array(F.lit(2.0))))
    assert tuple(n.first()) == (1, 1) and both.count() == 2
    assert one(spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))) == 0


def test_exact_neighbours_among_many_copies(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    # Copies, and multiples whose cosine is the same: smallest ids first, though they come last.
    x[100:250] = x[100]
    x[250:] = x[100] * np.arange(2, 52)[:, None]
    ids = rng.permutation(300)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    u = np.zeros((300, 8))
    u[ids] = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    got = {}
    for r in vectors.knn_exact(df, df, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.doc_id
    for i in range(300):
        assert [got[i][n] for n in range(1, 6)] == sorted(range(300), key=lambda j: (-s[i][j], j))[:5]


def test_logs(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("b", 5.0, 3)], "k string, v double, ts int")
    assert logs.query_stats(df.filter("false"), F.col("v"), F.col("v"), "ts").count() == 0
    assert logs.hit_rate(df, F.col("v") > 2, ["k"]).filter("k = 'a'").first().hit_rate == 50.0
    assert logs.gauges(df, "v", "ts", ["k"]).filter("k = 'a'").first().value == 3.0
    quota = logs.topic_quota(spark.range(10).withColumn("t", F.lit("x")), "t", "id", F.lit(10), 25, batch=2)
    assert quota.count() == 4


def test_incremental(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "b.txt").write_text("2")
    before = spark.createDataFrame(incremental.manifest(spark, f"file://{tmp_path}").collect())
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("3")
    got = {r.path[-5:]: r.change for r in incremental.diff(incremental.manifest(spark, f"file://{tmp_path}"), before).collect()}
    assert got == {"a.txt": "modified", "b.txt": "deleted", "c.txt": "new"}
    df = spark.createDataFrame([("1", "t", "a"), ("2", "t", "b"), (None, "t", "c")], "pmid string, title string, abstract string")
    embed = lambda d: vectors.hashed_terms(d, "pmid", "text")
    done, store = f"{tmp_path}/done", f"{tmp_path}/store"
    incremental.run(df, done, store, embed)
    incremental.run(df, done, store, embed)
    keys = sorted(r.pmid for r in spark.read.parquet(store).filter("pmid is not null").collect())
    assert keys == ["1", "2"]
    assert incremental.remove(df, spark.createDataFrame([("1",)], "pmid string"), "pmid").count() == 2
    q = spark.createDataFrame([(1, "x"), (2, "y")], "query_id int, query string")
    reuse = spark.createDataFrame([(1, 7)], "query_id int, cached_id int")
    rows, totals = incremental.answer_batch(q, reuse, lambda d: d.filter("false"))
    assert tuple(totals.first()) == (2, 1, 1, 1)
