"""SimHash components and repeated passages against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from conftest_rows import ROWS

from corvane.llm import simhash, substring_dedup


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints(odd):
    for text in [r[1] for r in ROWS] + ["a\x0bb\x1cc d e", "É É É"]:
        assert simhash.fingerprint(text or "") == plain(text)


def test_components_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: plain(r.text) for r in rows}
    want = brute_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


def test_links_connect_everything_in_crowded_buckets(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 400:
        x = rng.choice(sorted(prints)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = {int(np.array(p, np.uint64).view(np.int64)): p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "_fp bigint")
    want = brute_components(signed)
    for bucket in (1, 8, 1000):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, bucket)).collect()}
        groups = {}
        for s in signed:
            groups.setdefault(roots.get(s, s), set()).add(s)
        brute = {}
        for s, r in want.items():
            brute.setdefault(r, set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_links_within_three_bits(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64)}
    while len(prints) < 300:
        x = rng.choice(sorted(prints)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = {int(np.array(p, np.uint64).view(np.int64)): p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed], "_fp bigint")
    want = {(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 3}
    for bucket in (1, 1000):
        assert {(r.u, r.v) for r in simhash.links(df, bucket, radius=3).collect()} == want


def test_near_copies_go(spark):
    # Words as texts have them: a few very common ones and many rare ones. Copies with words changed, at 0.8 to 1.
    rng = random.Random(12)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(3)) for _ in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("abcdefghijklm") for _ in range(7))
    rows, copies = [], set()
    for i in range(0, 600, 2):
        words = [word() for _ in range(rng.randint(120, 500))]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // rng.randint(55, 200))):
                changed[at] = word()
            a, b = (set(simhash.shingle_set(" ".join(w), 5).tolist()) for w in (words, changed))
            rows.append((i + 1, " ".join(changed)))
            if len(a & b) >= 0.8 * len(a | b):
                copies.add(i + 1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in simhash.representatives(df).collect()}
    gone = {i for i, _ in rows} - kept
    assert len(copies) > 100 and gone <= copies
    assert len(gone) >= 0.95 * len(copies)


def test_near_copies_of_all_lengths(spark):
    # Similarity alone decides; all texts share a passage, so that unlike ones share keys too.
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(4))
    line = [word() for _ in range(12)]
    rows, copies = [], {60: set(), 120: set(), 400: set()}
    for n, changes in ((60, 1), (120, 2), (400, 8)):
        for _ in range(120):
            words = [*[word() for _ in range(n // 2)], *line, *[word() for _ in range(n - n // 2 - 12)]]
            changed = list(words)
            for at in rng.sample(range(n), changes):
                changed[at] = word()
            i = len(rows)
            rows += [(i, " ".join(words)), (i + 1, " ".join(changed))]
            a, b = (set(simhash.shingle_set(t, 5).tolist()) for _, t in rows[-2:])
            if len(a & b) >= 0.8 * len(a | b):
                copies[n].add(i + 1)
    kept = {r.doc_id for r in simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= set.union(*copies.values())
    for n, ids in copies.items():
        assert len(ids) > 60 and len(ids & gone) >= 0.95 * len(ids), n


def test_many_copies_of_one_fingerprint(spark):
    base = [f"w{i % 50}" for i in range(200)]
    df = spark.createDataFrame([(i, " ".join([*base, f"end{i}"])) for i in range(300)], "doc_id bigint, text string")
    assert [r.doc_id for r in simhash.representatives(df).collect()] == [0]


@pytest.mark.parametrize("block", [2048, 16])
def test_pairs_of_a_crowded_key(spark, monkeypatch, block):
    """Pairs of near copies that share one key with all others: what the key's least document resembles is not all that is alike there."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(simhash, "_keys", lambda each: each.selectExpr("doc", "CAST(1 AS bigint) AS key"))
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == list(range(0, 80, 2))


def test_all_pairs_of_balls(spark):
    # Every pair within 2 bits, also where many fingerprints share a half.
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32, 64)) for b in base for _ in range(150)} | set(base) | {rng.getrandbits(64) for _ in range(50)} | {0, 1 << 63, (1 << 64) - 1}
    signed = sorted(p - (1 << 64 if p >> 63 else 0) for p in prints)
    want = {(u, v) for n, v in enumerate(signed) for u in signed[:n] if ((u ^ v) & (1 << 64) - 1).bit_count() <= 2}
    got = [(r.u, r.v) for r in simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "_fp bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "u bigint, v bigint")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]


def test_simhash_odd_rows(odd, nothing):
    got = simhash.classes(odd)
    assert got.count() == odd.count()
    zero = {r.doc_id: r.component_id for r in got.collect() if r.fingerprint == "0" * 16}
    assert zero == {3: 3, 4: 3, 5: 3}
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert simhash.classes(nothing).count() == 0 and simhash.representatives(nothing).count() == 0


def test_compact_windows_hold_every_subsequence():
    rng = np.random.default_rng(1)
    h, t = rng.permutation(60).astype(np.uint64), 7
    windows = list(zip(*(x.tolist() for x in substring_dedup.compact_windows((h + np.uint64(1)) << np.uint64(32), t)), strict=True))
    for i in range(len(h)):
        for j in range(i + t - 1, len(h)):
            inside = [c for left, c, right in windows if left <= i <= c <= j <= right]
            assert inside == [i + int(h[i : j + 1].argmin())]


def test_repeated_passages_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(n)] for n in (51, 60, 120)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + passages[i % 9 // 3] + text[at:]
        docs.append((i, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert sorted(got) == [i for i in range(60) if i % 3 == 0]
    for i, r in got.items():
        words = docs[i][1].split()
        want = passages[i % 9 // 3]
        at = next(k for k in range(len(words)) if words[k : k + len(want)] == want)
        covered = {k for s in r.spans for k in range(s.start, s.end)}
        assert covered <= set(range(at, at + len(want))) and len(covered) >= len(want) - 10


def test_passage_of_two_documents_around_a_line_of_many(spark):
    rng = random.Random(9)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs, want = [], []
    for group in range(0, 4000, 100):
        line, before, after = some(44), some(3), some(3)
        for i in range(group, group + 12):
            near = i - group in (4, 9)
            docs.append((i, " ".join(some(60) + before * near + line + after * near + some(60))))
        want += [group + 4, group + 9]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert sorted(got) == want and all(sum(s.end - s.start for s in r.spans) >= 45 for r in got.values())


@pytest.mark.parametrize(("many", "block"), [(100, 4096), (400, 4096), (400, 64)])
def test_passage_of_two_documents_around_a_line_of_a_large_group(spark, monkeypatch, many, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = random.Random(9)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(n)]
    docs, want = [], {}
    for group in range(0, 15 * many, many):
        line, before, after = some(44), some(3), some(3)
        near = rng.sample(range(many), 2)
        for i in range(many):
            docs.append((group + i, " ".join(some(60) + before * (i in near) + line + after * (i in near) + some(60))))
        want |= {group + i: group + min(near) for i in near}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == want and all(sum(s.end - s.start for s in r.spans) >= 45 for r in got.values())


def test_links_of_a_large_group_grow_with_its_windows(spark, monkeypatch):
    # A passage between words of each document's own, a line that comes again and again, and near copies of a text; the groups fill up to 26 blocks.
    monkeypatch.setattr(substring_dedup, "BLOCK", 64)
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, line, text = some(60), some(2), some(120)
    kinds = [lambda: some(50) + passage + some(50), lambda: some(50) + line * 80 + some(50), lambda: (lambda k: text[:k] + some(1) + text[k + 1 :])(rng.randrange(120))]
    for kind in kinds:
        count = {}
        for many in (100, 400):
            df = spark.createDataFrame([(i, " ".join(kind())) for i in range(many)], "doc_id bigint, text string").repartition(3)
            numbered = substring_dedup._numbered(df, "doc_id", "text").cache()
            count[many] = substring_dedup.candidates(numbered).count()
        assert count[400] <= 1.5 * 4 * count[100]
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(df).collect()}
    assert got == dict.fromkeys(range(400), 0)


@pytest.mark.parametrize("block", [4096, 16])
def test_passage_that_comes_twice_in_each_document_of_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = random.Random(12)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage = some(60)
    docs = [(i, " ".join(some(120) + passage + some(120) + passage + some(120))) for i in range(40)]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()}
    assert sorted(got) == list(range(40)) and {r.class_id for r in got.values()} == {0}
    assert {i: [(x.start, x.end) for x in r.spans] for i, r in got.items()} == {i: [(120, 180), (300, 360)] for i in got}


def test_classes_are_connected(spark):
    # Two passages in 40 documents each; one document has both, and copies of it do not hide that.
    rng = random.Random(10)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    x, y, z = some(60), some(60), some(60)
    texts = [some(30) + x + some(30) for _ in range(40)] + [some(30) + y + some(30) for _ in range(40)] + [some(30) + z + some(30) for _ in range(40)]
    texts += [x + some(20) + y] * 30
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {i: 80 if 80 <= i < 120 else 0 for i in range(150)}


def test_near_equal_passages(spark):
    rng = random.Random(11)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    docs, far = [], []
    for g in range(0, 200, 4):
        # 50 words with one changed and 100 with two share 0.80 and 0.81 of their shingles; 50 with two share 0.64.
        for i, (n, changed) in enumerate(((50, (25,)), (100, (33, 66)))[g % 8 // 4 : g % 8 // 4 + 1] + ((50, (17, 33)),)):
            passage = some(n)
            other = [some(1)[0] if j in changed else w for j, w in enumerate(passage)]
            docs += [(g + 2 * i + j, " ".join(some(80) + p + some(80))) for j, p in enumerate((passage, other))]
        far += [g + 2, g + 3]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    assert not set(got) & set(far)
    assert len(got) >= 0.95 * (len(docs) - len(far))
    assert all(80 <= s.start + 5 and s.end <= 185 for r in got.values() for s in r.spans)


def test_passages_of_documents_against_all_pairs(spark):
    # Every passage of 50 equal words is found, and hardly any that is similar by 0.8 is missed; nothing else is told.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 500")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    s = {i: (substring_dedup.shingles([t])[0] >> np.uint64(32)).astype(np.uint32) for i, t in rows.items()}
    ids = sorted(i for i in s if len(s[i]) >= substring_dedup.LENGTH)
    sets = {i: set(s[i].tolist()) for i in ids}
    near, equal = set(), {}
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 30 and (substring_dedup.similar(s[a], s[b]) or substring_dedup.similar(s[b], s[a])):
                near |= {a, b}
    windows = {}
    for i in ids:
        for k in range(len(s[i]) - substring_dedup.LENGTH + 1):
            windows.setdefault(s[i][k : k + substring_dedup.LENGTH].tobytes(), []).append((i, k))
    for places in windows.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                equal.setdefault(i, set()).update(range(k, k + 50))
    got = {r.doc_id: {w for x in r.spans for w in range(x.start, x.end)} for r in substring_dedup.repeated_passages(docs).collect()}
    assert set(got) <= near and len(equal) > 40
    assert len(got) >= 0.95 * len(near)
    assert set(equal) <= set(got)
    assert sum(len(w & got[i]) for i, w in equal.items()) >= 0.98 * sum(map(len, equal.values()))


def test_near_equal_passages_in_a_large_group(spark):
    # One passage in 300 documents, each with a word of 60 changed at a place of its own.
    rng = random.Random(13)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage = some(120)
    docs = []
    for i in range(300):
        own = list(passage)
        for at in (rng.randrange(60), 60 + rng.randrange(60)):
            own[at] = some(1)[0]
        docs.append((i, " ".join(some(rng.randint(20, 80)) + own + some(rng.randint(20, 80)))))
    docs += [(i, " ".join(some(200))) for i in range(300, 600)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id for r in substring_dedup.repeated_passages(df).collect()}
    assert got <= set(range(300)) and len(got) >= 0.95 * 300


def test_passages_odd_rows(odd, nothing):
    got = substring_dedup.repeated_passages(odd)
    assert got.count() == 0
    assert substring_dedup.repeated_passages(nothing).count() == 0
    twice = odd.unionByName(odd.selectExpr("*").withColumn("doc_id", odd.doc_id + 100))
    assert {r.doc_id for r in substring_dedup.repeated_passages(twice).collect()} == {9, 109}
