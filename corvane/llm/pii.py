"""Personal data by a semi-Markov conditional random field.

Texts are read once. Where they hold digits or an "@" they are cut into islands: tokens that
hang together. Over an island's units (runs of letters and digits, and single signs) a
segmentation chooses spans with types and leaves the rest outside. A span is scored as a whole
(its groups of digits, its signs, check digits, octets, domain, what stands around it), a pair
of neighbouring labels by a transition, and bounded-entity dynamic programming over spans of at
most UNITS units finds the best segmentation, boundaries and types together.

There are no labels for personal data, so the field is fitted, by likelihood, on what the base
rules find in a bounded sample of islands and on rewritten copies of it: a phone number without
its plus, a card number in groups, an address with its "@" written out. It so learns spans
that the rules' patterns do not reach. All spans of the rules stay; a span of the field is
added where it overlaps none of them and its posterior probability is at least LEAST.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

# Kinds in order, and the patterns of the base rules, written so that no run is searched twice: nothing else can be found from within one.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Units of a span, and its characters, at most.
UNITS, WIDE = 20, 64
#: Islands that the field is fitted on: with spans of the rules, and without. Rounds over them.
FOUND, BARE, ROUNDS = 320, 160, 6
#: Least posterior of a span that is added.
LEAST = 0.8
_TRIGGER = re.compile(r"[0-9@]+")
_SPACE = re.compile(r"\s")
_UNIT = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]", re.S)
_FAR = -1e30

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the rules find: leftmost, without overlaps within a kind; failing matches are dropped and not searched again. Time is linear in the text."""
    out: list[Span] = []
    at = text.find("@")
    floor = 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        # Signs of a local part end at the last "@"; a run is walked once.
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


@dataclass
class Island:
    """A stretch of a text: where it begins, its text, what stands before and after it, and the rules' spans in it (from its begin)."""

    at: int
    text: str
    before: str
    after: str
    base: list[Span]


def islands(text: str, base: list[Span]) -> list[Island]:
    """Tokens with digits or an "@" that follow each other with one space between; widened to whole tokens and to the rules' spans."""
    bounds: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = m.span()
        if bounds:
            gap = text[bounds[-1][1] : lo] if lo - bounds[-1][1] <= 2 * WIDE else None
            if gap is not None and len(s := _SPACE.findall(gap)) <= 1 and (not s or s == [" "]):
                bounds[-1][1] = hi
                continue
        bounds.append([lo, hi])
    wide = []
    for lo, hi in bounds:
        left = lo
        while left > max(0, lo - WIDE) and not text[left - 1].isspace():
            left -= 1
        right = hi
        while right < min(len(text), hi + WIDE) and not text[right].isspace():
            right += 1
        wide.append((left, right))
    merged: list[list[int]] = []
    for lo, hi in sorted([*wide, *((s, e) for _, s, e in base)]):
        if merged and lo < merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    out, ordered, at = [], sorted(base, key=lambda x: (x[1], x[0])), 0
    for lo, hi in merged:
        inside = []
        while at < len(ordered) and ordered[at][1] < hi:
            k, s, e = ordered[at]
            inside.append((k, s - lo, e - lo))
            at += 1
        out.append(Island(lo, text[lo:hi], text[max(0, lo - 20) : lo], text[hi : hi + 1], inside))
    return out


def _class(c: str) -> str:
    return "-" if not c else "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c.isspace() else c


def features(span: str, before: str, after: str) -> list[str]:
    """Names of what a whole span shows; before and after are what stands around it."""
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    signs = re.sub("[A-Za-z0-9]", "", span)
    out = [
        f"digits {min(len(digits), 20)}",
        "groups " + (",".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"),
        "signs " + "".join(sorted(set(signs))),
        f"first {_class(span[0])}",
        f"prev {_class(before[-1:])}",
        f"next {_class(after[:1])}",
        f"letters {any(c.isalpha() for c in span)}",
        f"length {min(len(span) // 4, 12)}",
    ]
    if "@" in span:
        domain = span.rpartition("@")[2]
        out += [f"ats {min(span.count('@'), 2)}", f"dots {min(domain.count('.'), 3)}", f"domain {bool(DOMAIN.fullmatch(domain))}"]
    if 13 <= len(digits) <= 19:
        out.append(f"check {luhn(digits)}")
    if len(groups) == 4:
        out.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    word = re.search(r"([A-Za-z]{2,12})[^A-Za-z0-9]{1,3}$", before)
    return [*out, f"word {word.group(1).lower()}"] if word else out


def lattice(island: Island) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Bounds of the units, and candidate spans as (first bound, last bound, features).

    Spans begin and end where no run of letters and digits is cut, begin with one or with "+"
    or "(", end with one, and hold a digit or an "@". The rules' spans are candidates whatever
    their length; their ends are bounds.
    """
    text = island.text
    bounds = sorted({0, len(text), *(m.end() for m in _UNIT.finditer(text)), *(x for _, s, e in island.base for x in (s, e))})
    place = {b: i for i, b in enumerate(bounds)}
    whole = lambda i: 0 < i < len(text) and text[i - 1].isascii() and text[i - 1].isalnum() and text[i].isascii() and text[i].isalnum()
    spans = {(place[s], place[e]) for _, s, e in island.base}
    for i, s in enumerate(bounds[:-1]):
        if not (text[s].isascii() and (text[s].isalnum() or text[s] in "+(")) or whole(s) or (s == 0 and island.before[-1:].isascii() and island.before[-1:].isalnum()):
            continue
        for j in range(i + 1, min(i + UNITS, len(bounds) - 1) + 1):
            e = bounds[j]
            if e - s > WIDE:
                break
            if text[e - 1].isascii() and text[e - 1].isalnum() and not whole(e) and _TRIGGER.search(text, s, e):
                spans.add((i, j))
    around = island.before + text + island.after
    n = len(island.before)
    return bounds, [(i, j, features(text[bounds[i] : bounds[j]], around[max(0, n + bounds[i] - 20) : n + bounds[i]], around[n + bounds[j] : n + bounds[j] + 1])) for i, j in sorted(spans)]


@dataclass
class Field:
    """Weights of features by kind, and of a label after another (0 outside, then the kinds)."""

    weights: dict[str, list[float]] = field(default_factory=dict)
    moves: list[list[float]] = field(default_factory=lambda: [[0.0] * (len(KINDS) + 1) for _ in range(len(KINDS) + 1)])

    def scores(self, names: list[str]) -> list[float]:
        out = [0.0] * len(KINDS)
        for f in names:
            w = self.weights.get(f)
            if w:
                for k in range(len(KINDS)):
                    out[k] += w[k]
        return out


LABELS = len(KINDS) + 1


def _sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top <= _FAR else top + math.log(sum(math.exp(x - top) for x in xs))


def _edges(model: Field, n: int, spans: list) -> list[list[tuple[int, int, float, int]]]:
    """For each bound the edges that end there: begin, label, score, number of the span (-1 outside)."""
    out: list[list] = [[] for _ in range(n)]
    for j in range(1, n):
        out[j].append((j - 1, 0, 0.0, -1))
    for number, (i, j, names) in enumerate(spans):
        out[j] += [(i, k + 1, s, number) for k, s in enumerate(model.scores(names))]
    return out


def _entering(model: Field, row: list[float]) -> list[float]:
    return [_sum([row[a] + model.moves[a][b] for a in range(LABELS)]) for b in range(LABELS)]


def forward(model: Field, edges: list) -> tuple[list[list[float]], list[list[float]]]:
    """Log sums over all ways to each bound by last label, and to each bound before a next label. Before the first bound all is outside."""
    alpha = [[0.0] + [_FAR] * (LABELS - 1)]
    before = [_entering(model, alpha[0])]
    for j in range(1, len(edges)):
        into: list[list[float]] = [[] for _ in range(LABELS)]
        for i, y, s, _ in edges[j]:
            into[y].append(before[i][y] + s)
        alpha.append([_sum(x) if x else _FAR for x in into])
        before.append(_entering(model, alpha[j]))
    return alpha, before


def backward(model: Field, edges: list) -> list[list[float]]:
    """Log sums over all ways from each bound to the end, by the label that ended there."""
    n = len(edges)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    for j, into in enumerate(edges):
        for i, y, s, _ in into:
            out[i].append((j, y, s))
    beta = [[_FAR] * LABELS for _ in range(n)]
    beta[-1] = [0.0] * LABELS
    for i in range(n - 2, -1, -1):
        ways: list[list[float]] = [[] for _ in range(LABELS)]
        for j, y, s in out[i]:
            ways[y].append(s + beta[j][y])
        then = [_sum(x) if x else _FAR for x in ways]
        beta[i] = [_sum([model.moves[a][b] + then[b] for b in range(LABELS)]) for a in range(LABELS)]
    return beta


def best(model: Field, edges: list) -> list[tuple[int, int, int]]:
    """The best segmentation's spans as (label, number, bound where it ends); ties go to the label outside, then to the earlier edge."""
    top = [[0.0] + [_FAR] * (LABELS - 1)]
    came: list[list] = [[None] * LABELS]
    lead = []

    def entering(row: list[float]) -> list[tuple[float, int]]:
        return [max(((row[a] + model.moves[a][b], -a) for a in range(LABELS))) for b in range(LABELS)]

    lead.append(entering(top[0]))
    for j in range(1, len(edges)):
        row, back = [_FAR] * LABELS, [None] * LABELS
        for i, y, s, number in edges[j]:
            if (v := lead[i][y][0] + s) > row[y]:
                row[y], back[y] = v, (i, -lead[i][y][1], number)
        top.append(row)
        came.append(back)
        lead.append(entering(row))
    out, j = [], len(edges) - 1
    y = max(range(LABELS), key=lambda a: (top[j][a], -a))
    while j > 0:
        i, prev, number = came[j][y]
        if y:
            out.append((y, number, j))
        j, y = i, prev
    return out[::-1]


def gradient(model: Field, n: int, spans: list, gold: dict[int, int]) -> tuple[float, dict[str, list[float]], list[list[float]]]:
    """Log likelihood of a segmentation (number of span: label) and its gradient in weights and moves."""
    edges = _edges(model, n, spans)
    alpha, before = forward(model, edges)
    beta = backward(model, edges)
    total = _sum(alpha[-1])
    by_feature: dict[str, list[float]] = {}
    moves = [[0.0] * LABELS for _ in range(LABELS)]
    for j in range(1, n):
        for i, y, s, number in edges[j]:
            for a in range(LABELS):
                p = math.exp(min(0.0, alpha[i][a] + model.moves[a][y] + s + beta[j][y] - total))
                moves[a][y] -= p
            if y:
                p = math.exp(min(0.0, before[i][y] + s + beta[j][y] - total))
                for f in spans[number][2]:
                    by_feature.setdefault(f, [0.0] * len(KINDS))[y - 1] -= p
    at, last, value = 0, 0, 0.0
    ends = {spans[k][0]: (k, y) for k, y in gold.items()}
    while at < n - 1:
        k, y = ends.get(at, (-1, 0))
        value += model.moves[last][y] + (model.scores(spans[k][2])[y - 1] if y else 0.0)
        moves[last][y] += 1
        if y:
            for f in spans[k][2]:
                by_feature.setdefault(f, [0.0] * len(KINDS))[y - 1] += 1
        at, last = (spans[k][1] if y else at + 1), y
    return value - total, by_feature, moves


def _gold(island: Island, bounds: list[int], spans: list) -> dict[int, int]:
    """The rules' spans as a segmentation: earlier ones first, then longer ones, where they overlap."""
    number = {(bounds[i], bounds[j]): k for k, (i, j, _) in enumerate(spans)}
    out, upto = {}, 0
    for kind, s, e in sorted(island.base, key=lambda x: (x[1], -x[2], x[0])):
        if s >= upto:
            out[number[s, e]] = kind + 1
            upto = e
    return out


def rewritten(island: Island, rng: random.Random) -> Island | None:
    """The island with one of the rules' spans written in another way; its label stays. None if it has none that can be."""
    if not island.base:
        return None
    at = rng.randrange(len(island.base))
    kind, s, e = island.base[at]
    if any(s < e2 and s2 < e for i, (_, s2, e2) in enumerate(island.base) if i != at):
        return None
    span = island.text[s:e]
    if kind == 0:
        new = span.replace("@", rng.choice([" @ ", "(at)", "[at]"]))
    elif kind == 1:
        new = span.replace(".", rng.choice(["[.]", "(.)"]))
    elif kind == 2:
        d = re.sub("[^0-9]", "", span)
        new = rng.choice([" ", "-", "."]).join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        new = rng.choice([span[1:], span[1:].replace(" ", "."), re.sub("[()]", "", span[1:]), span.replace(" ", "/")])
    move = lambda x: x if x <= s else x + len(new) - len(span)
    return Island(island.at, island.text[:s] + new + island.text[e:], island.before, island.after, [(k, move(a), move(b)) for k, a, b in island.base])


def fit(found: list[Island], bare: list[Island], rounds: int = ROUNDS, seed: int = 7, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """A field fitted by steps along the likelihood's gradient (Adagrad), in a fixed order."""
    rng = random.Random(seed)
    cases = []
    for island in [*found, *(v for x in found if (v := rewritten(x, rng))), *bare]:
        bounds, spans = lattice(island)
        if spans:
            cases.append((len(bounds), spans, _gold(island, bounds, spans)))
    model = Field()
    if not any(gold for _, _, gold in cases):
        return model
    seen: dict = {}

    def step(w: list[float], g: list[float], key: object) -> None:
        s = seen.setdefault(key, [1e-6] * len(w))
        for k in range(len(w)):
            d = g[k] - decay * w[k]
            if d:
                s[k] += d * d
                w[k] += rate * d / math.sqrt(s[k])

    for _ in range(rounds):
        rng.shuffle(cases)
        for case in cases:
            _, by_feature, moves = gradient(model, *case)
            for f, g in by_feature.items():
                step(model.weights.setdefault(f, [0.0] * len(KINDS)), g, f)
            for a in range(LABELS):
                step(model.moves[a], moves[a], a)
    return model


def added(model: Field, island: Island, least: float = LEAST) -> list[Span]:
    """The field's spans that overlap none of the rules' and are likely enough (from the island's begin)."""
    bounds, spans = lattice(island)
    if not spans or not model.weights:
        return []
    edges = _edges(model, len(bounds), spans)
    chosen = [(y, k, j) for y, k, j in best(model, edges) if all(bounds[spans[k][0]] >= e or bounds[j] <= s for _, s, e in island.base)]
    if not chosen:
        return []
    (alpha, before), beta = forward(model, edges), backward(model, edges)
    total, out = _sum(alpha[-1]), []
    for y, k, j in chosen:
        score = model.scores(spans[k][2])[y - 1]
        if before[spans[k][0]][y] + score + beta[j][y] - total >= math.log(least):
            out.append((y - 1, bounds[spans[k][0]], bounds[j]))
    return out


SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
ISLANDS = f"array<struct<at:bigint,text:string,before:string,after:string,base:{SPANS}>>"
_ISLAND = pa.struct([("at", pa.int64()), ("text", pa.string()), ("before", pa.string()), ("after", pa.string()), ("base", _SPAN)])


def _named(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def _island(x: dict) -> Island:
    return Island(x["at"], x["text"], x["before"], x["after"], [(b["kind"], b["start"], b["end"]) for b in x["base"]])


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, base (the rules' spans), islands of every row; texts are read whole, and only islands are carried on."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, parts = [], []
            for t in b.column(1).to_pylist():
                found = base_spans(t)
                base.append(_named(found))
                parts.append([{"at": x.at, "text": x.text, "before": x.before, "after": x.after, "base": _named(x.base)} for x in islands(t, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _SPAN), pa.array(parts, pa.list_(_ISLAND))], names=["_id", "base", "islands"])

    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return base.mapInArrow(work, f"_id {base.schema['_id'].dataType.simpleString()}, base {SPANS}, islands {ISLANDS}")


def train(extracted: DataFrame, found: int = FOUND, bare: int = BARE) -> Field:
    """A field fitted on at most ``found`` islands with spans of the rules and ``bare`` without: of distinct ones those of smallest hash, as many of each first kind as there is room for."""
    each = extracted.select(F.explode("islands").alias("x")).select("x.*").filter(F.char_length("text") <= 16 * WIDE).drop("at").dropDuplicates(["text", "before"])
    kind = F.when(F.size("base") == 0, -1).otherwise(F.col("base")[0]["kind"])
    # Each kind's share is a bounded top by hash, taken in the tasks first.
    rows = []
    for k in range(-1, len(KINDS)):
        rows += each.filter(kind == k).withColumn("_h", F.xxhash64("text", "before")).orderBy("_h", "text", "before").limit(bare if k < 0 else found // len(KINDS)).collect()
    made = [_island(r.asDict(recursive=True) | {"at": 0}) for r in rows]
    return fit([x for x in made if x.base], [x for x in made if not x.base])


def find(extracted: DataFrame, model: Field, id_col: str = "doc_id", least: float = LEAST) -> DataFrame:
    """``id_col``, base, spans: the rules' spans, and all spans by kind and start, in code points, end exclusive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                more = [(k, x["at"] + s, x["at"] + e) for x in parts for k, s, e in added(model, _island(x), least)]
                out.append(_named(sorted([*((x["kind"], x["start"], x["end"]) for x in base), *more])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, _SPAN)], names=["_id", "base", "spans"])

    kind = extracted.schema["_id"].dataType.simpleString()
    return extracted.mapInArrow(work, f"_id {kind}, base {SPANS}, spans {SPANS}").withColumnRenamed("_id", id_col)


def of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find`` over ``docs`` with a field fitted on their own islands.

    One row per row: repeated rows stay, null ids too. Null and empty texts have no spans; a
    table without spans of the rules leaves nothing to fit, and nothing is added. Equal
    scores go outside first, then to the kind listed first.
    """
    extracted = stored(extract(docs, id_col, text_col), "islands")
    return find(extracted, train(extracted), id_col)
