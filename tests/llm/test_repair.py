"""Conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from corvane.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"


def broken(rows):
    """Conversations after damage: {conv: [(turn, role, text)] in order}."""
    out = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out[c] += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}:{r[2]}".encode()).hexdigest())
    return {c: sorted(x, key=key) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra over (rows done, roles written); all edits of the least cost, the least by ASCII."""
    ok = re.compile("(s?(ua)+)?")
    begins = re.compile("s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, w, said = heapq.heappop(heap)
        state = (i, w[:1] == "s", w[-1:], bool(re.search("ua", w)))
        if state in done:
            continue
        done.add(state)
        if i == len(rows) and ok.fullmatch(w):
            return cost, edits, said
        steps = [(3, "I", i, "u", ("user", "")), (3, "I", i, "a", ("assistant", ""))]
        if i < len(rows):
            more = 3 if found[i] == "truncated" else 0
            steps.append((4, "D", i + 1, None, None))
            if found[i] not in ("blank", "duplicate"):
                steps += [(3 + more, "R", i + 1, "u", ("user", rows[i][2])), (3 + more, "R", i + 1, "a", ("assistant", rows[i][2]))]
                if rows[i][1][:1] in ("s", "u", "a"):
                    steps.append((more, "K", i + 1, rows[i][1][0], rows[i][1:]))
        for c, e, j, x, line in steps:
            new = w if x is None else w + x
            if begins.fullmatch(new):
                heapq.heappush(heap, (cost + c, edits + e, j, new if len(new) < 5 else new[:-2], said if line is None else (*said, line)))
    raise AssertionError


def plain(rows):
    out = {}
    for c, x in broken(rows).items():
        found = faults(x)
        turns = [r[0] for r in x if r[0] is not None]
        initials = [r[1][:1] for r in x]
        cost, edits, said = cheapest(x, found)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest()
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, digest)
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "u", "Assistant"]) if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, rng.choice([t, t, t, None, t - 1]), role, rng.choice(["Hi.", "Who? ", "yes", "So on and", "A\u0085", "  ", "", None, f"Said {t}!", f"{t}."])))
    return rows


def test_against_every_path(spark):
    rows = conversations(250, 3) + [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (900, None, None, None), (901, 4, "system", "s."), (902, 1, "user", "x." + " \n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("_c", "n", "audit", "blank", "piece")})
    assert got(repair.of_damaged(df)) == plain(rows)


def test_pieces_and_long_conversations(spark, monkeypatch):
    """Pieces of three rows and prefixes put aside early give what whole conversations give; so does a turn repeated a thousand times."""
    monkeypatch.setattr(repair, "PIECE", 3)
    rows = conversations(40, 5, 60) + [(77, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(700)] + [(78, 1, "user", "again.")] * 1000
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair.of_damaged(df)) == plain(rows)


def test_rows_are_what_the_edits_say(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("assistant", "Lone."), ("system", "Late."), ("user", "One?"), ("user", "Two?"), ("user", "Two?"), ("assistant", "Three")])] + [(2, 0, "user", "Hi.")]
    fixed = repair.Repair(spark.createDataFrame(rows, SCHEMA))
    audits = {r.conv_id: r.audit for r in fixed.summary.collect()}
    out = {}
    for r in fixed.rows().orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text, r.edit))
    for c, edits in audits.items():
        assert "".join(x[2] for x in out[c]) == edits.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0][0] for x in out[c]))
    assert out[2] == [("user", "Hi.", "K"), ("assistant", "", "I")]


def test_grammar_spells_its_sequences(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("uaX") for _ in range(rng.randint(0, 50))) for _ in range(100)] + ["ua" * 300, "X" * 101] * 3
    rules, packed = repair.grammar(spark.createDataFrame([(t,) for t in texts], "symbols string"))

    def spelt(x):
        return "".join(spelt(rules[ord(c) - repair.FIRST_RULE]) if ord(c) >= repair.FIRST_RULE else c for c in x)

    rows = packed.collect()
    assert {r.symbols for r in rows} == set(texts) and all(spelt(r.packed) == r.symbols for r in rows)
    assert 0 < len(rules) <= repair.RULES and len(next(r.packed for r in rows if r.symbols == "ua" * 300)) < 40
    of = repair.matrices(rules)
    for r in rows:
        fold, by_row = repair._Fold(of), repair._Fold(of)
        fold.add(r.packed)
        by_row.add(r.symbols)
        assert fold.end() == by_row.end()


def test_nothing_left(spark):
    rows = [(c, 0, "user", "a.") for c in range(200)]
    gone = [c for c, x in broken(rows).items() if not x]
    assert gone
    res = got(repair.of_damaged(spark.createDataFrame(rows, SCHEMA)))
    assert res == plain(rows) and all(res[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)
    assert repair.of_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_and_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert got(queries.op13_conversation_repair(spark, data)) == {r[0]: r[1:] for r in con.sql(queries.ORACLE["op13_conversation_repair"]).fetchall()}
    whole = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, data)) == plain(whole)
