"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. The distinct words of the corpus (the matches of the tokenizer's pattern) are counted, with
   a map-side combine, over all texts.
2. Merges are replayed over the distinct words, each of them once for the whole corpus: words
   are laid end to end as bytes, and an inverted index leads from each token that a pair of
   neighbours would make to the positions of such pairs. Merges apply in rank order over all
   words of a partition at once: a merge visits the positions the index lists for it and
   touches the pair's two neighbours only. Words do not affect one another, so partitions of
   the words give what one index would.
3. The encodings of the CORPUS_WORDS most frequent words are broadcast (a bounded table, tens
   of MB) and spell out the texts where they lie; no text is shuffled. What is rarer still is
   replayed in the same way where it lies: such words occur in few places each, and a table
   of all of them would grow with the corpus.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_as_struct, text_or_empty

#: Words whose encodings every worker gets; only words met so often count.
CORPUS_WORDS, LEAST_COUNT = 300_000, 3
#: Words that a task counts before it passes them on, and words of one replay.
COUNTED_WORDS, REPLAYED_WORDS = 400_000, 50_000
#: Bytes of text in a block, rare words that a worker keeps, and pairs of tokens whose rank it keeps.
BLOCK_BYTES = 500_000
KEPT_WORDS = 120_000
KEPT_PAIRS = 240_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """The ranks of a vocabulary file (a base64 token and its rank a line) and the tokens by rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


class Vocabulary:
    """Ranks, tokens and what pairs of tokens make; ``made`` fills up as pairs are met."""

    def __init__(self, path: str):
        self.ranks, self.tokens = load_ranks(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.made: dict[int, int] = {}
        self.first = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)

    def makes(self, a: int, b: int) -> int:
        """Rank of the token that two neighbours make, or -1."""
        r = self.made[a << 32 | b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of every word: of the pairs present, the one that makes the token of least rank merges first, the leftmost first."""
    made, makes = vocabulary.made, vocabulary.makes
    # Words lie end to end with a gap after each; every byte is a token at first.
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1)
    text = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
    gap = np.zeros(len(text), bool)
    gap[ends - 1] = True
    ids = np.where(gap, -1, vocabulary.single[text]).tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = np.where(gap[:-1] | gap[1:], -1, vocabulary.first[text[:-1], text[1:]])
    places = np.flatnonzero(pairs >= 0)
    places = places[np.argsort(pairs[places], kind="stable")]
    starts = np.flatnonzero(np.diff(pairs[places], prepend=-1))
    index = {int(pairs[part[0]]): part.tolist() for part in np.split(places, starts[1:]) if len(part)}
    queue = sorted(index)
    while queue:
        rank = heapq.heappop(queue)
        listed = index.pop(rank, None)
        if listed is None:
            continue
        listed.sort()
        for at, i in enumerate(listed):
            a, j = ids[i], after[i]
            b = ids[j] if j < n else -1
            # The index is not cleared when a neighbour changes: a place counts if it still makes this token.
            if a < 0 or b < 0:
                continue
            r = made.get(a << 32 | b)
            if (makes(a, b) if r is None else r) != rank:
                continue
            ids[i] = rank
            ids[j] = -2
            k = after[i] = after[j]
            h = before[i]
            lowest = rank
            if k < n:
                before[k] = i
                b = ids[k]
                if b >= 0:
                    r = made.get(rank << 32 | b)
                    if r is None:
                        r = makes(rank, b)
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(queue, r)
                        lowest = min(lowest, r)
            if h >= 0 and (a := ids[h]) >= 0:
                r = made.get(a << 32 | rank)
                if r is None:
                    r = makes(a, rank)
                if r >= 0:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(queue, r)
                    lowest = min(lowest, r)
            if lowest < rank:
                # A token of lower rank came up: it goes first, then the rest of this one.
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank] += listed[at + 1 :]
                break
    kept = np.array(ids, np.int64)
    upto = np.concatenate([[0], np.cumsum(kept >= 0)])
    cuts = upto[np.concatenate([[0], ends])]
    kept = kept[kept >= 0].astype("<u4").tobytes()
    return [kept[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def corpus_words(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """word, n: every distinct word of the corpus and how often it occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall = regex.compile(pattern).findall
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0):
                found.update(findall(text.as_py()))
                if len(found) > COUNTED_WORDS:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """word, ids of a table of distinct words, by replay over each partition's words."""

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, REPLAYED_WORDS):
                part = b.column(0).slice(at, REPLAYED_WORDS)
                yield pa.RecordBatch.from_arrays([part, pa.array(replay([w.encode() for w in part.to_pylist()], vocabulary), pa.binary())], names=["word", "ids"])
            if len(vocabulary.made) > KEPT_PAIRS:
                vocabulary.made.clear()

    return words.select("word").mapInArrow(replayed, "word string, ids binary")


def frequent_words(docs: DataFrame, path: str, pattern: str, text_col: str = "text", most: int = CORPUS_WORDS) -> Broadcast:
    """The ``most`` most frequent words of the corpus with their ids, for all workers; ties go by the word. Words met under LEAST_COUNT times are left to where they lie."""
    words = corpus_words(docs, pattern, text_col).filter(F.col("n") >= LEAST_COUNT)
    top = words.orderBy(F.col("n").desc(), "word").limit(most).select("word").repartition("word")
    table = encoded_words(top, path).toArrow().combine_chunks()
    return docs.sparkSession.sparkContext.broadcast((table.column("word").combine_chunks(), table.column("ids").combine_chunks()))


class Encoder:
    """Encodes texts block by block by the corpus's frequent words. Of rarer words those met before are kept, up to KEPT_WORDS: half of them young, half of them old and dropped next."""

    def __init__(self, path: str, pattern: str, words: dict[str, bytes] | None = None):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.words = words or {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def block(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        known, young = self.words, self.young
        here: dict[str, bytes] = {}
        fresh = []
        for w in set().union(*split):
            ids = known.get(w)
            if ids is None:
                ids = young.get(w)
                if ids is None:
                    ids = self.old.get(w)
                    if ids is None:
                        fresh.append(w)
                        continue
                    young[w] = ids
            here[w] = ids
        if fresh:
            made = dict(zip(fresh, replay([w.encode() for w in fresh], self.vocabulary), strict=True))
            young.update(made)
            here.update(made)
        out = [b"".join(map(here.__getitem__, words)) for words in split]
        if len(young) > KEPT_WORDS // 2:
            self.old, self.young = young, {}
        if len(self.vocabulary.made) > KEPT_PAIRS:
            self.vocabulary.made.clear()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, pattern: str, words: Broadcast, corpus: str) -> Encoder:
    """One for all tasks of a Python worker: that of the last corpus it was asked for."""
    if corpus not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[corpus] = Encoder(path, pattern, dict(zip(*(c.to_pylist() for c in words.value), strict=True)))
    return _ENCODERS[corpus]


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``limit`` bytes of a text column; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def spell(ids: list[bytes | None], tokens: list[bytes]) -> pa.Array:
    """The bytes that packed ids stand for."""
    return pa.array([b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in ids], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Two columns: _row (a row of ``docs``, its columns in ``keep`` or all) and ids (binary: little-endian unsigned 32-bit integers).

    With decoded, a third: what the ids decode to, as ``decode`` gives it, without passing
    the rows through a second Python worker. A null text counts as empty and has no ids.
    Strings that name special tokens are ordinary text. The texts are read twice: for the
    corpus's words at once, and again by what uses the result.
    """
    words, corpus = frequent_words(docs, path, pattern, text_col), uuid.uuid4().hex

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in blocks(b, 1):
                own = encoder(path, pattern, words, corpus)
                ids = own.block(part.column(1).to_pylist())
                more = [spell(ids, own.vocabulary.tokens)] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), *more], names=["_row", "ids", "decoded"][: 2 + decoded])

    base = docs.select(rows_as_struct(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep else docs), text_or_empty(text_col).alias("_text"))
    return base.mapInArrow(encoded, f"_row {base.schema['_row'].dataType.simpleString()}, ids binary{', decoded binary' if decoded else ''}")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The columns of ``encoded`` and ``out_col``, the bytes (binary) that the ids stand for; null ids count as none."""
    names = encoded.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = load_ranks(path)
        for batch in batches:
            for b in blocks(batch, names.index(ids_col)):
                yield pa.RecordBatch.from_arrays([*b.columns, spell(b.column(names.index(ids_col)).to_pylist(), tokens)], names=[*names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(read, f"{schema}, `{out_col}` binary")


def id_array(ids: str = "ids"):
    """Expression: packed ids as an array of longs."""
    h = F.hex(ids)
    le = lambda i: F.conv(F.concat(*[F.substring(h, i * 8 + 7 - 2 * j, F.lit(2)) for j in range(4)]), 16, 10).cast("bigint")
    return F.when(F.octet_length(ids) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), le)).otherwise(F.array().cast("array<bigint>"))
