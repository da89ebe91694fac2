from __future__ import annotations

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from corvane.llm import bpe, exact_dedup, simhash
from corvane.llm.queries import RANKS


def one_of_each(texts):
    """The smallest id of each group of near copies, by comparing all pairs."""
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [i for i in ids if find(i) == i]


def test_stages_follow_one_another(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == names, name
        seen.append(docs)
    toxic, exact, near, mixed, ids = seen
    assert exact.count() == exact_dedup.mark_duplicates(toxic).filter("kept").count()
    assert sorted(r.doc_id for r in near.collect()) == one_of_each({r.doc_id: r.text or "" for r in exact.collect()})
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS)[0], special_tokens={})
    want = sorted((r.doc_id, len(t := own.encode_ordinary(r.text)), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in ids.collect()) == want


def test_stages_take_odd_and_empty_rows(spark, odd, nothing, data):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, data).columns == odd.columns, name
        assert stage(spark, odd, data).count() > 0
        assert stage(spark, nothing, data).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, data).count() == odd.count()


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.select(F.count(F.lit(1))).first()[0] > 0
