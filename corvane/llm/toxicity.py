"""Toxicity scoring by a weighted lexicon.

Texts are folded (compatibility forms, homoglyphs, digits and signs that stand for letters,
case, punctuation), an Aho-Corasick automaton finds all lexicon terms of a whole text in one
pass, hits inside exception phrases do not count, and the summed weights are normalised by
length. The lexicon (whole words and word stems), its weights, the learnt exception phrases
and the calibration come from labelled documents; callers may add terms and phrases.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, rows_as_struct, text_or_empty

# Letters of other scripts that look like Latin ones, then digits and signs written for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһκνοραιτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХ", "aeopcyxijsdhkvopaituabezhikmnoptyxabekmhopctx")
DIGITS = str.maketrans("0134578", "oieastb")
SIGNS = {"@": "a", "$": "s", "!": "i"}
_SIGN = re.compile(r"[@$!](?=[^\W_])")
_DIGITS = re.compile("[0134578]+")
_FOREIGN = re.compile(f"[{''.join(map(chr, HOMOGLYPHS))}]")
_WORD = re.compile(r"[^\W_]+")

STEM = range(3, 9)
#: Log of the odds that a term is in so many toxic texts by chance: about one in 400,000.
ODDS = 13
FEATURES = 3
#: Rows scored and passed on at once.
SLICE = 500


def _sign(m: re.Match) -> str:
    """A sign before a letter stands for one; an exclamation mark only within a word."""
    return SIGNS[m[0]] if m[0] != "!" or m.string[m.start() - 1 : m.start()].isalnum() else m[0]


def _digits(m: re.Match) -> str:
    """Digits beside a letter stand for letters."""
    beside = m.string[m.start() - 1 : m.start()] + m.string[m.end() : m.end() + 1]
    return m[0].translate(DIGITS) if any(c.isalpha() for c in beside) else m[0]


def fold(text: str) -> str:
    """The text as words of letters between single spaces, with a space at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if _FOREIGN.search(text):
        text = text.translate(HOMOGLYPHS)
    text = _SIGN.sub(_sign, text)
    text = _DIGITS.sub(_digits, text)
    return f" {' '.join(_WORD.findall(text))} "


@dataclass
class Lexicon:
    """terms: folded pattern -> weight; a pattern starts with a space (word or stem) and ends with one if it is a whole word. exceptions: folded phrases."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    beta: tuple[float, ...] = (-4.0, 2.0, 1.0, 0.0)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("terms", "exceptions", "beta")}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for p in self.exceptions:
            found.add_word(p, (len(p), None))
        for p, weight in self.terms.items():
            if p not in self.exceptions:
                found.add_word(p, (len(p), weight))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of each hit outside exception phrases; of hits that start together, the heaviest."""
        if self.automaton is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, (n, weight) in self.automaton.iter(folded):
            start = last + 1 - n
            if weight is None:
                spared.append((start, last + 1))
            elif start not in best or weight > best[start][1]:
                best[start] = (last + 1, weight)
        # The farthest end of all phrases that start up to each phrase's start: a hit is spared if one of those reaches its end.
        spared.sort()
        starts = [a for a, _ in spared]
        ends = list(itertools.accumulate((b for _, b in spared), max))
        free = lambda s, e: not (i := bisect.bisect_right(starts, s)) or ends[i - 1] < e
        return [(s, e, w) for s, (e, w) in sorted(best.items()) if free(s, e)]

    def features(self, text: str) -> tuple[float, float, float]:
        """Heaviest hit, log of the summed weight per 100 words, log of the summed weight."""
        folded = fold(text)
        found = self.hits(folded)
        total = sum(w for _, _, w in found)
        words = max(1, folded.count(" ") - 1)
        return max((w for _, _, w in found), default=0.0), math.log1p(100 * total / words), math.log1p(total)

    def score(self, text: str) -> float:
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in STEM if n < len(w)}


def _sketch(folded: str) -> int:
    """The least hash of the words' pairs, which near copies mostly share: copies of one text then count as one."""
    words = folded.split()
    return min((xxhash.xxh32_intdigest(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or words, strict=False)), default=0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the toxic texts of a batch with the text's sketch, each pair once."""
    for b in batches:
        seen: set[tuple[str, int]] = set()
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if y == 1:
                folded = fold(text)
                s = _sketch(folded)
                seen.update((t, s) for t in _terms(folded))
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "sketch"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label and sketch of every text."""
    for b in batches:
        found = [_sketch(fold(t)) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.int64())], names=["y", "sketch"])


def choose_terms(counts: Iterable[tuple[str, int, int]], positives: int, negatives: int) -> dict[str, float]:
    """Weights of the terms that mark toxic texts.

    counts: term, toxic and other texts that hold it. A term is taken if so many toxic texts
    would hold it by chance with odds of one in exp(ODDS), and nine of ten texts that hold it
    are toxic. A stem whose texts nearly all hold one longer term gives way to that term; of
    the rest, a term with a stem that is as telling gives way to the stem.
    """
    base = positives / max(1, positives + negatives)
    good = {}
    for term, pos, neg in counts:
        n = pos + neg
        if pos >= 0.9 * n and n and pos * math.log(1 / base) + (neg * math.log(1 / (1 - base)) if neg else 0) - (math.lgamma(n + 1) - math.lgamma(pos + 1) - math.lgamma(neg + 1)) > ODDS:
            good[term] = (math.log((pos + 0.5) / (positives + 1)) - math.log((neg + 0.5) / (negatives + 1)), neg / n, pos)
    stems_of = lambda term: [s for n in range(STEM.start + 1, len(term)) if (s := term[:n]) in good]
    loose = {s for term in good for s in stems_of(term) if good[term][2] >= 0.95 * good[s][2]}
    out: dict[str, float] = {}
    for term in sorted(good.keys() - loose, key=lambda t: (len(t), t)):
        stems = [term[:n] for n in range(STEM.start + 1, len(term)) if term[:n] in out]
        if not any(good[s][1] <= good[term][1] for s in stems):
            out[term] = good[term][0]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_documents: int = 8000, extra_terms: dict[str, float] | None = None, extra_exceptions: Iterable[str] = ()) -> Lexicon:
    """Learns the lexicon from at most ``max_documents`` labelled documents for which ``use`` (over the labels) holds.

    They are those of smallest hash of the id, so a rerun takes the same ones. Near copies of
    a text count once under its label. A word before or after a term makes an exception phrase if at least three
    texts hold it and four fifths of them are not toxic. Rows with a null id or label teach
    nothing; without both labels the lexicon holds only ``extra_terms``.
    """
    chosen = (
        labels.filter(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_documents)
    )
    sample = cut(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "y").repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism)))
    by_label = {r["y"]: r["n"] for r in sample.mapInArrow(_sketches, "y int, sketch bigint").distinct().groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positives, negatives = by_label.get(1, 0), by_label.get(0, 0)
    terms = {fold(t): w for t, w in (extra_terms or {}).items()}
    lexicon = Lexicon(terms, {fold(p) for p in extra_exceptions})
    if not positives or not negatives:
        return lexicon
    base = positives / (positives + negatives)
    toxic = (
        sample.mapInArrow(_counted, "term string, sketch bigint")
        .groupBy("term", "sketch")
        .agg(F.lit(1).alias("_"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("pos"))
        # What the odds of choose_terms need at the very least, at most one text in nine being of the other label.
        .filter(F.col("pos") * (math.log(1 / base) + math.log(1 / (1 - base)) / 9) > ODDS)
    )
    pos = {r["term"]: r["pos"] for r in toxic.collect()}

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[str, int]] = set()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if y != 1:
                    folded = fold(text)
                    s = _sketch(folded)
                    seen.update((t, s) for t in _terms(folded) if t in pos)
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "sketch"])

    neg = {r["term"]: r["neg"] for r in sample.mapInArrow(elsewhere, "term string, sketch bigint").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("neg")).collect()}
    learnt = choose_terms([(t, n, neg.get(t, 0)) for t, n in pos.items()], positives, negatives)
    lexicon = Lexicon(learnt | terms, lexicon.exceptions)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[str, int, int]] = set()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded = fold(text)
                near = set()
                for start, end, _ in lexicon.hits(folded):
                    left = folded.rfind(" ", 0, start)
                    right = folded.find(" ", end - (folded[end - 1] == " "))
                    after = folded.find(" ", right + 1)
                    near |= {folded[max(left, 0) : right + 1]} if start > 0 else set()
                    near |= {folded[start : after + 1]} if after > 0 else set()
                if near:
                    s = _sketch(folded)
                    seen.update((p, y, s) for p in near)
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["p", "y", "sketch"])

    spare = sample.mapInArrow(phrases, "p string, y int, sketch bigint").distinct().groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count(F.lit(1)).alias("n")).filter("n >= 3 and pos <= 0.2 * n")
    lexicon = Lexicon(lexicon.terms, lexicon.exceptions | {r["p"] for r in spare.collect()})

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([lexicon.features(t) for t in b.column(0).to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(FEATURES)), b.column(1)], names=["a", "b", "c", "y"])

    seen = sample.mapInArrow(measured, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    return Lexicon(lexicon.terms, lexicon.exceptions, fit_logistic(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy(float)))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Two columns: _row (a row of ``docs``, its columns in ``keep`` or all) and _score in 0 to 1. Null and empty texts score as texts without a hit."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                out = pa.array([lexicon.score(t) for t in part.column(1).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["_row", "_score"])

    base = docs.select(rows_as_struct(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs), text_or_empty(text_col).alias("_text"))
    return base.mapInArrow(scored, f"_row {base.schema['_row'].dataType.simpleString()}, _score double")
