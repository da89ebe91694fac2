from __future__ import annotations

import base64
import gzip
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet
import pytest
import tiktoken
from conftest_rows import ROWS
from pyspark.sql import functions as F

from corvane.llm import ann, bpe, mixing, warc
from corvane.llm.common import new_folder
from corvane.llm.queries import ORACLE

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_targets_by_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, None: 70, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    weight = dict(zip(order, [5, 2, 1] * 3, strict=False))
    left, target, free = sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    assert all(abs(got[s] - target[s]) < 1e-9 for s in order)


def paths_of(counts):
    """The path of every source, counted plainly."""
    levels = max(1, (len(counts) - 1).bit_length())
    group = lambda level, g: sum(counts[g << level : (g + 1) << level])
    return [tuple(group(level, (s >> level + 1) * 2 + side) for level in reversed(range(levels)) for side in (0, 1)) for s in range(len(counts))]


def test_quotas_are_exact_and_fair():
    counts, shards = (1000, 37, 0, 400, 5), 13
    paths = paths_of(counts)
    held = {s: [mixing.Tree(shards, 4).shard_of(b, s, paths[s]) for b in range(n)] for s, n in enumerate(counts)}
    q = [[held[s].count(i) for s in held] for i in range(shards)]
    assert all(h == sorted(h) for h in held.values())
    assert max(map(sum, q)) - min(map(sum, q)) <= 1
    # Over many seeds, a shard's blocks of a source have the mean and the variance of a hypergeometric draw.
    paths, seen = paths_of((60, 30, 10)), []
    for seed in range(400):
        tree = mixing.Tree(4, seed)
        seen.append([sum(tree.shard_of(b, s, paths[s]) == 2 for b in range(n)) for s, n in enumerate((60, 30, 10))])
    mean, var = np.mean(seen, axis=0), np.var(seen, axis=0)
    share = np.array([0.6, 0.3, 0.1])
    assert np.allclose(mean, 25 * share, atol=0.4) and np.allclose(var, 25 * share * (1 - share) * 75 / 99, rtol=0.3)


def test_group_counts(spark):
    counts = [7, 1, 4, 0, 9, 2]
    df = spark.createDataFrame([(i, f"s{i}", float(c * 10)) for i, c in enumerate(counts)], "_place bigint, source string, target double")
    got = {r._place: tuple(r.path) for r in mixing.group_counts(df, 10).collect()}
    assert got == dict(enumerate(paths_of(counts)))


def test_shards_hold_their_quotas(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    order = sorted(mixing.plan(docs)[0].collect(), key=lambda r: r._place)
    blocks = [-(-round(r.target) // 64) for r in order]
    paths = paths_of(blocks)
    kw = {"block_words": 64, "shard_blocks": 50}

    def words(seed):
        mix = mixing.draw(*mixing.plan(docs, seed=seed), **kw, seed=seed)
        return {(r._source, r.shard): r.w for r in mix.groupBy("_source", "shard").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("w")).collect()}

    total = sum(round(r.target) for r in order)
    size, shards = mixing.sized(total, **kw)
    assert size == 64 and shards > 3
    held = {seed: words(seed) for seed in (11, 12)}
    for seed, got in held.items():
        tree = mixing.Tree(shards, seed)
        want = {}
        for i, r in enumerate(order):
            for b in range(blocks[i]):
                at = (r.source, tree.shard_of(b, i, paths[i]))
                want[at] = want.get(at, 0) + min(64, round(r.target) - 64 * b)
        assert got == want
    assert held[11] != held[12]


def test_pieces_put_together_are_the_text(spark):
    texts = ["  one\ttwo \n\n three four  ", "x " * 500, "a\n" * 300, None, ""]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rows = mixing.mixed_documents(docs, pieces=True, block_words=16, shard_blocks=4).collect()
    assert len({r._shard for r in rows}) > 3
    for i, t in enumerate(texts[:3]):
        first = sorted((r._first_word, r.text) for r in rows if r.doc_id == i and r._pass == 0)
        whole = "".join(x for _, x in first)
        assert t.startswith(whole) and whole


def test_mix_meets_targets_and_reruns_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")

    def run(d):
        sources, planned = mixing.plan(d)
        return sources, mixing.taken(planned, mixing.draw(sources, planned, block_words=64, shard_blocks=50))

    sources, first = run(docs)
    rows = sorted(map(tuple, first.collect()))
    assert rows == sorted(map(tuple, run(docs.repartition(5))[1].collect()))
    assert len(rows) == docs.count() and all(t <= 3 * size for _, size, _, _, t, _ in rows)
    taken = first.join(docs.select(F.col("doc_id").alias("_id"), "source"), "_id").groupBy("source").agg(F.sum("taken").alias("t")).collect()
    target = {r.source: r.target for r in sources.collect()}
    assert all(abs(r.t - target[r.source]) <= 1 for r in taken)
    assert first.agg(F.max("shards")).first()[0] > 1


def test_mix_odd_rows(odd, nothing):
    sources, planned = mixing.plan(odd)
    got = mixing.taken(planned, mixing.draw(sources, planned))
    assert got.count() == odd.count()
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = mixed.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()[0]
    assert words == got.agg(F.sum("taken")).first()[0]
    sources, planned = mixing.plan(nothing)
    assert mixing.taken(planned, mixing.draw(sources, planned)).count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e", "ü" * 100000), (6, "http://f", "<p>x</p>"), (7, "http://g", "WARC/1.1\r\n\r\n")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit("mine")).repartition(3)
    folder = new_folder(spark, "warc-test")
    warc.write_archives(spark, pages, folder)
    got = {r.page_id: r for r in warc.page_records(spark, folder).collect()}
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(i, last.get(h or "", 0))
    for i, _, h in PAGES:
        raw = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
    one = warc.read_archives(spark, folder, page_id=5).collect()
    assert [bytes(r.payload).decode() for r in one] == ["ü" * 100000]
    fs, root = warc.filesystem(folder)
    whole = b""
    for f in fs.get_file_info(warc.pyarrow.fs.FileSelector(root)):
        with fs.open_input_file(f.path) as s:
            whole += gzip.decompress(s.read())
    assert whole.count(b"WARC-Type: ") == len(PAGES)  # any gzip reader can read the members
    least = warc.records(pages, least_bytes=5000)
    assert {r.record_type for r in least.collect()} == {"response"}


def test_warc_of_other_writers(tmp_path, spark):
    rec = warc.record({"WARC-Type": "response", "WARC-Target-URI": "u", "X-Page-ID": "1"}, b"one") + warc.record({"WARC-Type": "request", "X-Page-ID": "2"}, b"two" * 1000)
    (tmp_path / "a.warc").write_bytes(rec)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record({"WARC-Type": t, "X-Page-ID": str(i)}, b"z" * 100000)) for i, t in ((3, "response"), (4, "request"))))
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert {(r.page_id, r.record_type, len(r.payload)) for r in got} == {(1, "response", 3), (2, "request", 3000), (3, "response", 100000), (4, "request", 100000)}
    only = warc.read_archives(spark, f"file://{tmp_path}", record_type="request", page_id=[2, 9]).collect()
    assert [r.page_id for r in only] == [2]


def test_warc_filters_on_one_load(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "v", "same"), (3, "w", "other")], "page_id bigint, url string, html string")
    folder = new_folder(spark, "warc-reuse")
    warc.write_archives(spark, pages, folder)
    load = warc.read_archives(spark, folder)
    responses, revisits = load.filter("record_type = 'response'"), load.filter("record_type = 'revisit'")
    assert (responses.count(), revisits.count(), load.count()) == (2, 1, 3)
    assert responses.union(revisits).count() == 3 and load.filter("page_id = 3").count() == 1
    assert warc.read_archives(spark, folder, record_type="revisit").filter("page_id = 2").count() == 0


def test_warc_reads_large_payloads_in_linear_time():
    import io
    import time

    data = warc.member(warc.record({"WARC-Type": "response"}, b"0123456789abcdef" * (100 << 16)))
    began = time.time()
    (_, payload), = warc.read_archive(io.BytesIO(data), lambda h: True, True)
    assert len(payload) == 100 << 20 and time.time() - began < 10


def test_warc_reader_skips_payloads():
    class Counting(bytearray):
        pass

    import io

    data = b"".join(warc.member(warc.record({"WARC-Type": t}, bytes(np.random.default_rng(i).bytes(300000)))) for i, t in enumerate(["a", "b", "a"]))
    read = []

    class Stream(io.BytesIO):
        def readinto(self, b):
            n = super().readinto(b)
            read.append(n)
            return n

    heads = [h["warc-type"] for h, _ in warc.read_archive(Stream(data), lambda h: h["warc-type"] == "b", False)]
    assert heads == ["b"] and sum(read) < len(data) / 2


def test_warc_empty(spark):
    folder = new_folder(spark, "warc-none")
    warc.write_archives(spark, spark.createDataFrame([], "page_id bigint, url string, html string"), folder)
    assert warc.page_records(spark, folder).count() == 0


def brute_nearest(ids, x, q, k):
    s = {i: float(sum(float(a) * float(b) for a, b in zip(x[q], v, strict=True))) for i, v in x.items() if i != q}
    return sorted(s, key=lambda i: (-s[i], i))[:k]


def test_ann_finds_all_in_small_tables_with_copies(spark):
    rng = np.random.default_rng(2)
    x = {i: rng.normal(size=8).astype(np.float32) for i in range(200)}
    for i in range(50, 120):
        x[i] = x[50]
    rows = [(i, v.tolist(), "mine") for i, v in x.items()] + [(900, None, ""), (901, [0.0] * 8, ""), (902, [float("nan")] * 8, ""), (903, [None] + [1.0] * 7, ""), (None, [1.0] * 8, ""), (904, [1.0] * 3, ""), (50, x[50].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert sorted(got) == [i for i in range(0, 200, 20)]
    for q, ranks in got.items():
        assert [ranks[i] for i in range(1, 21)] == brute_nearest(None, x, q, 20)


def test_ann_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4.0)]
    assert ann.nearest(df.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_ann_recall(spark, spread, tmp_path):
    # 100,000 vectors without structure, of one norm and of log-normal norms: a query's 64 windows of 3 * 127 are a quarter of them at most.
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100_000, 64))
    x *= np.exp(spread * rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    pa.parquet.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x.astype(np.float32)))}), f"{tmp_path}/v.parquet")
    m = x.astype(np.float32).astype(float)
    got = ann.nearest(spark.read.parquet(f"{tmp_path}/v.parquet"), F.col("vec_id") % 500 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    hit = 0
    for q, found in got.items():
        s = m @ m[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20]))
    assert len(got) == 200 and hit / (20 * len(got)) >= 0.9


def test_ann_queries_in_one_place(spark):
    # All queries point the same way, and vectors have two lengths.
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    x[::2] = x[0] + 0.01 * rng.normal(size=x[::2].shape)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, v[:3].tolist()) for i, v in enumerate(x[:50])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 2 == 0).toPandas().groupby("query_id").vec_id.apply(list)
    assert len(got) == 1525 and all(len(f) == 20 for f in got)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    # Against the score of the 20th: near ties count.
    hit = sum((s[q, found] >= np.sort(s[q])[-20] - 1e-9).sum() for q, found in got.items() if q < 5000)
    assert hit / (20 * 1500) >= 0.9
    assert all(set(found) <= set(range(5000, 5050)) for q, found in got.items() if q >= 5000)


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def reference():
    ranks, _ = bpe.load_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, data):
    own = reference()
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["", "a" * 5000, "<|endoftext|> hi", " \n\n x　y", "日本🙂🙂", "aaaaabaaaab" * 300, "don't we'll\t\t12345", "\x00\x01"]
    got = bpe.Encoder(PATH, public_tokenizers.PATTERN).block(texts)
    assert got == [np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_bpe_replay_with_late_low_ranks():
    class Small(bpe.Vocabulary):
        def __init__(self, ranks):
            self.ranks = ranks | {bytes([b]): 1000 + b for b in range(256) if bytes([b]) not in ranks}
            self.tokens = [b""] * 2000
            for t, r in self.ranks.items():
                self.tokens[r] = t
            self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
            self.made = {}
            self.first = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)

    rng = np.random.default_rng(0)
    for _ in range(30):
        ranks = {}
        pieces = {bytes(rng.choice(list(b"abc"), size=int(rng.integers(2, 5)))) for _ in range(12)}
        for r, p in zip(rng.permutation(200), sorted(pieces), strict=False):
            ranks[p] = int(r)
        v = Small(ranks)
        words = [bytes(rng.choice(list(b"abc"), size=int(rng.integers(1, 20)))) for _ in range(20)]
        for w, got in zip(words, bpe.replay(words, v), strict=True):
            parts = [bytes([b]) for b in w]
            while True:
                r, i = min(((v.ranks.get(parts[i] + parts[i + 1], 9999), i) for i in range(len(parts) - 1)), default=(9999, 0))
                if r == 9999:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert np.frombuffer(got, "<u4").tolist() == [v.ranks[p] for p in parts]


def test_bpe_round_trip_of_odd_rows(odd, nothing):
    encoded = bpe.encode(odd, PATH, public_tokenizers.PATTERN)
    assert encoded.select("_row.*").columns == odd.columns
    back = bpe.decode(encoded.select(F.col("_row.text").alias("text"), "ids"), PATH).collect()
    assert sorted(bytes(r.decoded).decode() for r in back) == sorted(r[1] or "" for r in ROWS)
    both = bpe.encode(odd, PATH, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(bytes(r.decoded) for r in both) == sorted(bytes(r.decoded) for r in back)
    one = bpe.encode(odd.filter("doc_id = 1"), PATH, public_tokenizers.PATTERN, keep=["doc_id"]).select("ids", bpe.id_array().alias("a")).first()
    assert one.a == np.frombuffer(bytes(one.ids), "<u4").tolist()
    assert bpe.encode(nothing, PATH, public_tokenizers.PATTERN).count() == 0


def test_sql_parses():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for sql in ORACLE.values():
        assert c.sql(sql).columns
