"""Judgments by classes against the same judgments as pairs."""

from __future__ import annotations

import random

from corvane.operators import evaluate
from corvane.plans.corpus import label_judgments


def test_classes_as_pairs(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice([1, 2, 3, 3, 3, None]), rng.choice([0, 1, 2, None])) for i in range(60)] + [(60, 9, 2), (61, 8, 0), (62, 8, 1)]
    asked = [(i, c) for i, c, _ in docs if i % 4 == 0 or i > 59]
    pairs = [(q, d, g) for q, c in asked for d, k, g in docs if c is not None and c == k and q != d]
    hits = [(q, d, n + 1) for q, _ in asked for n, d in enumerate(rng.sample(range(63), 10)) if d != q]
    hits = spark.createDataFrame(hits, "query_id long, doc_id long, rank int")
    classes = evaluate.Classes(spark.createDataFrame(asked, "query_id long, class int"), spark.createDataFrame(docs, "doc_id long, class int, grade int"))
    rows = lambda judged: [[round(x, 9) for x in r] for r in evaluate.per_query(hits, judged).orderBy("query_id").collect()]
    got, want = rows(classes), rows(spark.createDataFrame(pairs, "query_id long, doc_id long, grade int"))
    assert got == want and len(got) == len({q for q, _, _ in pairs})


def test_labels_make_no_pairs(spark, data):
    """What is judged grows with the vectors, not with their square."""
    vectors, judged = spark.read.parquet(f"{data}/embeddings.parquet").count(), label_judgments(spark, data)
    assert judged.documents.count() == vectors and judged.queries.count() <= vectors
