"""Repair of conversations: the cheapest edits that give roles ``(s?(ua)+)?``, by grammar-compressed dynamic programming.

Every row becomes a symbol of its role and fault; a conversation is a string of them, cut into
pieces of PIECE rows. Re-Pair over the distinct pieces of all conversations replaces frequent
pairs of symbols by rules, round by round. A symbol stands for a min-plus matrix over the four
states that the roles written so far can be in, whose entries hold the least cost and its edits
as a rope; a rule's matrix is the product of its two parts' matrices, made once, bottom-up, and
shared by all conversations. A conversation is then a short product of matrices.

Equal costs go to the edits least in ASCII. Of edits of one stretch between the same states
with the same cost none begins another (what an insertion adds also costs), so the least
continue to the least, and the product keeps them.

Rows are numbered in one order of all conversations, so no task or window holds a conversation
until its edits, one letter a row and part of the result, are put together. A repaired
conversation is written in one task, a row at a time, as a digest over it must be.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, partitions, released, running, stored

#: White space that makes no text, and what ends a whole one.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of the edits, and of a row that stays without an end.
REROLE, DELETE, INSERT, UNENDED = 3, 4, 3, 3
#: Rows of a piece; rules of the grammar at most (their matrices go to every task: some 2 MB) and rounds of Re-Pair.
PIECE, RULES, ROUNDS = 1024, 256, 12
#: Symbols of rows: role, in capitals without an end, or to be deleted.
TERMINALS = "suaoSUAOX"
#: Rules are named by code points of a private area.
FIRST_RULE = 0xE000
#: States: nothing written, a system row, a user's turn, an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_SPOKEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}


class Rope:
    """Edits as a concatenation that is spelt out only where it is asked for."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: Rope | str, right: Rope | None = None):
        self.left, self.right, self._text = left, right, left if right is None else None

    @property
    def text(self) -> str:
        if self._text is None:
            out, stack = [], [self]
            while stack:
                x = stack.pop()
                if x._text is not None:
                    out.append(x._text)
                else:
                    stack += [x.right, x.left]
            self._text = "".join(out)
        return self._text


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1].text < old[1].text)


def product(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b: the least cost, then the least edits, over the states between."""
    out: Matrix = {}
    for (p, m), (c, x) in a.items():
        for (n, q), (d, y) in b.items():
            if m == n and ((p, q) not in out or c + d <= out[p, q][0]) and _better(new := (c + d, Rope(x, y)), out.get((p, q))):
                out[p, q] = new
    return out


def _inserted() -> Matrix:
    """Up to two insertions: more come back to a state at a cost."""
    out: Matrix = {(p, p): (0, Rope("")) for p in range(4)}
    for p, q in _SPOKEN.items():
        out[p, q] = (INSERT, Rope("I"))
        if p in (START, SYSTEM):
            out[p, ASSISTANT] = (2 * INSERT, Rope("II"))
    return out


def terminal(symbol: str) -> Matrix:
    """The matrix of a row, with what may be inserted before it."""
    row: Matrix = {(p, p): (DELETE, Rope("D")) for p in range(4)}
    if symbol != "X":
        more, role = UNENDED if symbol.isupper() else 0, symbol.lower()
        options = [(p, q, REROLE, "R") for p, q in _SPOKEN.items()] + [(START, SYSTEM, 0, "K")] * (role == "s") + [(p, q, 0, "K") for p, q in _SPOKEN.items() if role == {USER: "u", ASSISTANT: "a"}[q]]
        for p, q, cost, edit in options:
            if _better(new := (cost + more, Rope(edit)), row.get((p, q))):
                row[p, q] = new
    return product(_inserted(), row)


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """A matrix for each symbol; a rule's parts come before it."""
    out = {x: terminal(x) for x in TERMINALS}
    for i, pair in enumerate(rules):
        out[chr(FIRST_RULE + i)] = product(out[pair[0]], out[pair[1]])
    return out


def _chosen(pairs: list[str]) -> list[str]:
    """Pairs in order of frequency, without those that would take symbols from one already chosen."""
    out: list[str] = []
    for p in pairs:
        if all(p[0] != x[1] and p[1] != x[0] for x in out):
            out.append(p)
    return out


def grammar(sequences: DataFrame, most: int = RULES) -> tuple[list[str], DataFrame]:
    """Re-Pair over ``sequences`` (symbols): the rules' right sides in order, and symbols, packed of each distinct sequence.

    A round counts the pairs of all distinct sequences, each as often as it occurs and without
    overlaps, and replaces the most frequent ones that do not compete, until none occurs
    twice or there are ``most`` rules. Some counts of pairs come to the driver a round.
    """
    held = stored(sequences.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")).withColumn("packed", F.col("symbols")), "sequences")
    rules: list[str] = []
    for _ in range(ROUNDS):
        size = F.char_length("packed")
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.col("packed").substr(i, F.lit(2))))
        each = held.filter(size > 1).select("n", "packed", F.explode(pairs).alias("pair"))
        times = (F.char_length("packed") - F.char_length(F.replace("packed", F.col("pair"), F.lit("")))) / 2 * F.col("n")
        best = each.groupBy("pair").agg(F.sum(times).alias("times")).filter("times >= 2").orderBy(F.col("times").desc(), "pair").limit(64)
        found = _chosen([r["pair"] for r in best.collect()])[: most - len(rules)]
        if not found:
            break
        packed = F.col("packed")
        for pair in found:
            packed = F.replace(packed, F.lit(pair), F.lit(chr(FIRST_RULE + len(rules))))
            rules.append(pair)
        after = stored(held.withColumn("packed", packed), "sequences")
        released(held)
        held = after
    return rules, held.select("symbols", "packed")


def _runs(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with what the repair needs to know of them; equal rows of a turn are one, with their number: a turn repeated without end is one row before any shuffle."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    base = rows.select(key.alias("_c"), F.col(turn).cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    each = base.groupBy("_c", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    kept = F.rtrim("text", F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    return each.select(
        "*",
        F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256).alias("_h"),
        (kept == "").alias("blank"),
        (~F.substring(kept, -1, 1).isin(*ENDS)).alias("unended"),
        F.when(first.isin(*"sua"), first).otherwise("o").alias("initial"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("_h")]


def _legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin("su", "ua", "au")


def _pieces(slim: DataFrame) -> DataFrame:
    """_c, piece, symbols, illegal (pairs within), head, tail (initials) of at most PIECE runs each."""
    numbered = running(slim, [F.col("_c"), *_order()])
    symbol = F.when(F.col("gone"), "X").when(F.col("unended"), F.upper("initial")).otherwise(F.col("initial"))
    symbols = F.concat(symbol, F.repeat(F.lit("X"), (F.col("n") - 1).cast("int")))
    cut = numbered.select("_c", "_place", F.floor(F.col("_place") / PIECE).alias("piece"), "initial", symbols.alias("symbols"), (F.col("n") - 1).alias("alike"))
    rows = cut.groupBy("_c", "piece").agg(F.array_sort(F.collect_list(F.struct("_place", "initial", "symbols"))).alias("rows"), F.sum("alike").alias("alike"))
    others = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: (i > 0) & ~_legal(F.get(F.col("rows.initial"), i - 1), F.get(F.col("rows.initial"), i)))
    return rows.select("_c", "piece", F.array_join("rows.symbols", "").alias("symbols"), (F.col("alike") + F.size(others)).alias("illegal"), F.get("rows.initial", F.lit(0)).alias("head"), F.element_at("rows.initial", -1).alias("tail"))


class _Fold:
    """The best edits to each state over a conversation's pieces; what all of them begin with is put aside."""

    def __init__(self, of: dict[str, Matrix]):
        self.of, self.ready = of, []
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, packed: str) -> None:
        for symbol in packed:
            new: dict[int, tuple[int, str]] = {}
            for (p, q), (cost, edits) in self.of[symbol].items():
                if p in self.best and ((c := self.best[p][0] + cost) < new.get(q, (c + 1,))[0] or c == new[q][0]):
                    new[q] = min(new.get(q, (c + 1, "")), (c, self.best[p][1] + edits.text))
            self.best = new
            if max(len(x) for _, x in new.values()) > 4 * PIECE:
                low, high = (f(x for _, x in new.values()) for f in (min, max))
                same = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
                self.ready.append(low[:same])
                self.best = {q: (c, x[same:]) for q, (c, x) in new.items()}

    def end(self) -> tuple[int, str]:
        ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        cost, edits = min((c + INSERT * len(ends[q]), x + ends[q]) for q, (c, x) in self.best.items())
        return cost, "".join(self.ready) + edits


def _folded(pieces: DataFrame, rules: list[str]) -> DataFrame:
    """_c, cost, audit, illegal from each conversation's pieces in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = matrices(rules)

        @functools.lru_cache(maxsize=4096)
        def alone(packed: str) -> tuple[int, str]:
            fold = _Fold(of)
            fold.add(packed)
            return fold.end()

        held: tuple | None = None  # conversation, first piece, fold once there is a second, illegal, tail

        def closed(h: tuple) -> tuple:
            return (h[0], *(h[2].end() if h[2] else alone(h[1])), h[3])

        for b in batches:
            out = []
            for c, packed, illegal, head, tail in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[0] == c:
                    fold = held[2]
                    if fold is None:
                        fold = _Fold(of)
                        fold.add(held[1])
                    fold.add(packed)
                    held = (c, "", fold, held[3] + illegal + (held[4] + head not in ("su", "ua", "au")), tail)
                else:
                    out += [closed(held)] if held else []
                    held = (c, packed, None, illegal, tail)
            yield rows(out)
        yield rows([closed(held)] if held else [])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        c, cost, audit, illegal = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(illegal, pa.int64())], names=["_c", "cost", "audit", "illegal"])

    return pieces.select("_c", "packed", "illegal", "head", "tail").mapInArrow(work, "_c string, cost bigint, audit string, illegal bigint")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired rows in order: conversation, whether it begins, turn, role, text, edit. A conversation's first row is its audit; one without rows left has a row of nulls."""
    state, edits, at, c = START, "", 0, None

    def inserted():
        nonlocal state, at
        while at < len(edits) and edits[at] == "I":
            state, at = _SPOKEN[state], at + 1
            yield c, False, None, NAMES[state], "", "I"

    for b in batches:
        for key, audit, turn, role, text, n in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if audit is not None:
                yield from inserted()
                state, edits, at, c = START, audit, 0, key
                yield c, True, None, None, None, None
                continue
            for _ in range(n):
                yield from inserted()
                edit, at = edits[at], at + 1
                if edit == "R":
                    state = _SPOKEN[state]
                    yield c, False, turn, NAMES[state], text, "R"
                elif edit == "K":
                    state = SYSTEM if role.startswith("s") else _SPOKEN[state]
                    yield c, False, turn, role, text, "K"
    yield from inserted()


def _staged(runs: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, in one task."""
    empty = lambda c: F.lit(None).cast(c)
    first = audits.select("_c", "audit", empty("bigint").alias("turn"), empty("string").alias("role"), empty("string").alias("text"), F.lit(0).cast("bigint").alias("n"), empty("string").alias("_h"), F.lit(0).alias("_at"))
    rest = runs.select("_c", empty("string").alias("audit"), "turn", "role", "text", "n", "_h", F.lit(1).alias("_at"))
    both = first.unionByName(rest).repartition(partitions(runs.sparkSession), "_c").sortWithinPartitions("_c", "_at", *_order())
    return both.select("_c", "audit", "turn", "role", "text", "n")


class Repair:
    """The repair of a table of conversations: ``summary``, ``rows()`` and ``digests()``."""

    def __init__(self, conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        """Conversations are rows of (conv, turn, role, text), taken by turn, nulls first.

        Rows of one turn go by role, then by a digest of role and text; equal rows are
        adjacent. Null roles and texts are one space; rows without a conversation are one
        conversation. A row's first fault counts: blank (only white space), duplicate (its
        role and text were there before), truncated (its last letter is none of ``.!?``).
        Blank and duplicate rows must be deleted. A role counts by its first letter; one that
        is none of s, u, a cannot be kept. An empty table gives no rows.
        """
        self.conv, self.kind = conv, conversations.schema[conv].dataType
        self.runs = stored(_runs(conversations, conv, turn, role, text), "runs")
        many = self.runs.groupBy("_c", "_h").agg(F.count(F.lit(1)).alias("_times"), F.min("turn").alias("_first"), F.max(F.col("turn").isNull()).alias("_null")).filter("_times > 1")
        again = many.select(F.col("_c").alias("_d"), F.col("_h").alias("_g"), F.when(~F.col("_null"), F.col("_first")).alias("_first"))
        slim = self.runs.drop("text").join(again, (F.col("_c") == F.col("_d")) & (F.col("_h") == F.col("_g")), "left")
        later = F.col("_d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first"))
        slim = stored(slim.select("_c", "turn", "role", "_h", "n", "initial", "blank", "unended", later.alias("later"), (F.col("blank") | later).alias("gone")), "slim")
        pieces = stored(_pieces(slim.select("_c", "turn", "role", "_h", "n", "initial", "unended", "gone")), "pieces")
        rules, packed = grammar(pieces.select("symbols"))
        ordered = pieces.join(packed, "symbols").repartition(partitions(pieces.sparkSession), "_c").sortWithinPartitions("_c", "piece")
        self.audits = stored(_folded(ordered, rules), "audits")
        of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        spare = ~F.col("blank")
        counts = slim.groupBy("_c").agg(
            of(F.col("blank")).alias("blank"),
            F.sum(F.when(spare, F.col("n") - 1 + F.col("later").cast("int")).otherwise(0)).alias("duplicate"),
            F.count_if(spare & ~F.col("later") & F.col("unended")).alias("truncated"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        )
        id_ = F.when(F.col("_c") != "", F.substring("_c", 2, 1 << 30)).cast(self.kind).alias(conv)
        self.rules = rules
        self.summary = stored(counts.join(self.audits, "_c").select("_c", id_, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), "repair")
        released(pieces, slim)
        freed(conversations.sparkSession)

    def rows(self) -> DataFrame:
        """The repaired conversations: conv, place (from 0), turn (null for an inserted row), role, text, edit (K, R or I)."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, place = [], 0
            for c, begins, turn, role, text, edit in _replayed(batches):
                if begins:
                    place = 0
                    continue
                out.append((c, place, turn, role, text, edit))
                place += 1
                if len(out) == 1000:
                    yield table(out)
                    out = []
            yield table(out)

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["_c", "place", "turn", "role", "text", "edit"])

        out = _staged(self.runs, self.audits).mapInArrow(work, "_c string, place bigint, turn bigint, role string, text string, edit string")
        return out.select(F.when(F.col("_c") != "", F.substring("_c", 2, 1 << 30)).cast(self.kind).alias(self.conv), "place", "turn", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """_c, repaired_sha256: of each repaired conversation's ``role:text`` rows, joined by line feeds, read a row at a time."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done, c, h, first = [], None, None, True
            for key, begins, _, role, text, _ in _replayed(batches):
                if begins:
                    if h is not None:
                        done.append((c, h.hexdigest()))
                    c, h, first = key, hashlib.sha256(), True
                    if len(done) == 1000:
                        yield table(done)
                        done = []
                else:
                    h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield table(done + ([(c, h.hexdigest())] if h is not None else []))

        def table(done: list[tuple]) -> pa.RecordBatch:
            c, h = zip(*done, strict=True) if done else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()), pa.array(h, pa.string())], names=["_c", "repaired_sha256"])

        return _staged(self.runs, self.audits).mapInArrow(work, "_c string, repaired_sha256 string")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", by: int = 20) -> DataFrame:
    """conv, turn, role, text after faults put in by CRC-32 of ``conv:turn`` modulo ``by``: 0 drops a row, 1 empties its text, 2 takes its ends of sentences out, 3 repeats it, 4 makes its role user. Nulls are one space, also in the digest; a null turn stays null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % by
    base = rows.select(F.col(conv), F.col(turn), said(role).alias(role), said(text).alias(text), fault.alias("_fault")).filter("_fault <> 0")
    base = base.withColumns({text: F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(text, ENDS, "")).otherwise(F.col(text)), role: F.when(F.col("_fault") == 4, "user").otherwise(F.col(role))})
    return base.withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "_fault")


def of_damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of the table: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 after ``damaged`` and ``Repair``. One without rows after damage has zeros, no edits and the digest of nothing."""
    fixed = Repair(damaged(conversations, conv, turn, role, text), conv, turn, role, text)
    known = conversations.select(F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("_k"), F.col(conv)).distinct()
    both = fixed.summary.drop(conv).join(fixed.digests().withColumnRenamed("_c", "_d"), F.col("_c") == F.col("_d"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return known.join(both, F.col("_k") == F.col("_c"), "left").select(
        conv, *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
