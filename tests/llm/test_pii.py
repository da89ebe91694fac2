"""The semi-Markov field against every segmentation, the rules against their patterns as written."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import pytest

from corvane.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 // 10 + int(c) * 2 % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = "".join(c for c in m.group() if c in "0123456789")
        out += [(2, *m.span())] * (13 <= len(d) <= 19 and plain_luhn(d))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


PARTS = ["4032835936481012", "5555 5555-5555 4444", "+1 (487) 555-7209", "10.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "a.b@c.d", "x@y", "a@b@c.de.", "@", "+", ".", "-", " ", "  ", "\n", "é", "7", "00", "(", "word", "a%b", "+49301234567"]


def test_rules_are_their_patterns():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000, "0" * 5000 + ".1.1.1", "1 " * 300_000):
        pii.islands(text, pii.base_spans(text))


def ways(n, spans):
    """Every segmentation as (label, number) edges."""

    def from_(at):
        if at == n - 1:
            yield ()
            return
        for rest in from_(at + 1):
            yield ((0, -1), *rest)
        for k, (i, j, _) in enumerate(spans):
            if i == at:
                for rest in from_(j):
                    for y in range(1, pii.LABELS):
                        yield ((y, k), *rest)

    return from_(0)


def value(model, spans, way):
    last, out = 0, 0.0
    for y, k in way:
        out += model.moves[last][y] + (sum(model.weights.get(f, [0] * 4)[y - 1] for f in spans[k][2]) if y else 0)
        last = y
    return out


def some_model(spans, seed):
    rng = random.Random(seed)
    names = sorted({f for s in spans for f in s[2]})
    return pii.Field({f: [rng.gauss(0, 1) for _ in pii.KINDS] for f in names}, [[rng.gauss(0, 1) for _ in range(pii.LABELS)] for _ in range(pii.LABELS)])


@pytest.mark.parametrize("text", ["a1-22", "+1 23", "x@y.z", "4 5"])
def test_sums_and_best_against_every_segmentation(text):
    island = pii.islands(text, pii.base_spans(text))[0]
    bounds, spans = pii.lattice(island)
    model = some_model(spans, len(text))
    edges = pii._edges(model, len(bounds), spans)
    every = [(value(model, spans, w), w) for w in ways(len(bounds), spans)]
    total = math.log(sum(math.exp(v) for v, _ in every))
    alpha, before = pii.forward(model, edges)
    beta = pii.backward(model, edges)
    assert math.isclose(pii._sum(alpha[-1]), total, abs_tol=1e-9) and math.isclose(beta[0][0], total, abs_tol=1e-9)
    top = max(every, key=lambda x: x[0])[1]
    assert [(y, k) for y, k, _ in pii.best(model, edges)] == [e for e in top if e[0]]
    for k, (i, j, names) in enumerate(spans):
        for y in range(1, pii.LABELS):
            p = sum(math.exp(v - total) for v, w in every if (y, k) in w)
            assert math.isclose(math.exp(before[i][y] + model.scores(names)[y - 1] + beta[j][y] - total), p, abs_tol=1e-9)


def test_gradient_against_differences():
    text = "a +1 22 b@c.d"
    island = pii.islands(text, pii.base_spans(text))[0]
    bounds, spans = pii.lattice(island)
    gold = {len(spans) - 1: 1}
    model = some_model(spans, 9)
    _, by_feature, moves = pii.gradient(model, len(bounds), spans, gold)

    def at(change):
        change(1e-5)
        high = pii.gradient(model, len(bounds), spans, gold)[0]
        change(-2e-5)
        low = pii.gradient(model, len(bounds), spans, gold)[0]
        change(1e-5)
        return (high - low) / 2e-5

    for f, k in itertools.product(list(model.weights), range(4)):
        assert math.isclose(at(lambda d, f=f, k=k: model.weights[f].__setitem__(k, model.weights[f][k] + d)), by_feature.get(f, [0] * 4)[k], abs_tol=1e-5)
    for a, b in itertools.product(range(pii.LABELS), repeat=2):
        assert math.isclose(at(lambda d, a=a, b=b: model.moves[a].__setitem__(b, model.moves[a][b] + d)), moves[a][b], abs_tol=1e-5)


def test_islands_hold_every_rule_span():
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice([*PARTS, "and ", "plain words "]) for _ in range(rng.randint(0, 12)))
        base = pii.base_spans(text)
        parts = pii.islands(text, base)
        assert sorted((k, x.at + s, x.at + e) for x in parts for k, s, e in x.base) == sorted(base)
        assert all(a.at + len(a.text) <= b.at for a, b in itertools.pairwise(parts))
        for x in parts:
            bounds, spans = pii.lattice(x)
            assert {(s, e) for _, s, e in x.base} <= {(bounds[i], bounds[j]) for i, j, _ in spans}


def numbered(i):
    """A made-up card number that passes, one that fails, an address, a phone number, octets."""
    rng = random.Random(i)
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    check = next(c for c in "0123456789" if plain_luhn(head + c))
    bad = head + str((int(check) + 1 + i % 8) % 10)
    return head + check, bad, f"w{i}.x@mail{i % 7}.example.com", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", ".".join(str(rng.randint(1, 255)) for _ in range(4))


def test_field_adds_what_the_patterns_miss(spark):
    rows = []
    for i in range(300):
        card, bad, mail, phone, ip = numbered(i)
        rows.append((i, f"some words {card} then {bad} and\nwrite {mail} or {phone}, host {ip}. List 1. 2. and {i} items"))
    held = [numbered(1000 + i) for i in range(20)]
    rows += [(1000 + i, f"here {bad} {card} stands, write {mail.replace('@', ' @ ')} soon, pay {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} now") for i, (card, bad, mail, _, _) in enumerate(held)]
    rows += [(2000 + i, f"clean text {i} with {i * 7919} and 3.14 or v1.2.3 on 2024-05-{i + 10}, {bad}") for i, (_, bad, _, _, _) in enumerate(held)]
    extracted = pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string"))
    model = pii.train(extracted.filter("_id < 1000"))
    got = {r.doc_id: r for r in pii.find(extracted, model).collect()}
    texts = dict(rows)
    for i, r in got.items():
        assert [(x.kind, x.start, x.end) for x in r.base] == pii.base_spans(texts[i]) and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    more = {i: {texts[i][x.start : x.end] for x in r.spans} for i, r in got.items()}
    hits = sum((card in more[1000 + i]) + (mail.replace("@", " @ ") in more[1000 + i]) + (".".join(card[a : a + 4] for a in (0, 4, 8, 12)) in more[1000 + i]) for i, (card, _, mail, _, _) in enumerate(held))
    assert hits >= 54
    assert sum(bool(more[2000 + i]) for i in range(20)) == 0
    assert all(len(got[i].spans) == 4 for i in range(300))


def test_odd_tables(spark, odd, nothing):
    assert sorted((r.doc_id or 0, len(r.base), len(r.spans)) for r in pii.of_documents(odd).collect()) == sorted((r.doc_id or 0, 0, 0) for r in odd.collect())
    assert pii.of_documents(nothing).count() == 0


def test_query(spark, data):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op12_pii(spark, data).collect():
        want = plain(texts[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(want))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))
