"""Spelling variants: words one edit apart, found in tries of letter-group counts.

The letters fall into GROUPS groups, and a word is arranged in a trie by how many of its
letters are in the first group, the second and so on. Words that differ by one inserted,
deleted or replaced letter differ in these counts by a deficit of at most one and a surplus of
at most one, so a depth-first search from each word's own path spends a budget of one of each;
what it reaches at the leaves is compared letter by letter.

A pair is met once: the search takes the deficit first, so that a longer word asks for shorter
ones and of two equally long words the one with more letters in the first group that tells
them apart asks for the other (words of equal counts meet in their common leaf).

Spark deals the trie out by its top: the counts of the first few groups are the shuffle key,
and a word asks every key that the budget reaches, with what it has spent as its state (0
nothing, 1 the deficit, 2 both). The number of groups in the key is the least for which no key
has more than ``crowd`` words; keys that still have more are salted: their words are dealt
into parts, and those who ask meet all parts, in parts themselves, so that no task holds a
whole key and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, freed, partitions, released, stored

#: What a word is made of once A-Z is lower-cased; all are code points below 256, so a word is stored as one byte each.
RUN = "[a-zÀ-ÿ]+"
#: Letter groups: a code point's distance from "a", modulo this.
GROUPS = 16
#: Groups in the shuffle key at most, and words of a key before it takes more groups or is salted.
TOP, CROWD = 7, 16_000
#: Rows worked on at once, trie paths or pairs expanded at once, letters compared by matrix (longer words one by one).
BLOCK, SLICE, WIDE = 65_536, 250_000, 32

_GROUP = ((np.arange(256) - 97) % GROUPS).astype(np.int64)
_LETTERS = ["".join(chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)] if (c - 97) % GROUPS == g) for g in range(GROUPS)]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, run: every maximal run of letters of every text, A-Z in lower case. Null texts have none."""
    low = F.translate(F.col(text_col).cast("string"), UPPER, UPPER.lower())
    return docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))


def damaged(id_: Column, run: Column, every: int = 97) -> Column:
    """A run without its letter h % length where ``every`` divides h, the CRC-32 of '<id>:<run>'. A null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(id_, F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("bigint")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word, n of the rows of ``words`` (word) that are long enough and met often enough; counted before anything is shuffled."""
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _count(group: int) -> Column:
    """How many letters of ``word`` are in a group."""
    return F.char_length("word") - F.char_length(F.translate("word", _LETTERS[group], ""))


def _depth(words: DataFrame, crowd: int) -> int:
    """The least number of groups whose counts tell words apart well enough. One row for each number comes to the driver."""
    tops = words.select(*[_count(g).alias(f"c{g}") for g in range(TOP)])
    paths = tops.select(F.posexplode(F.array(*[F.concat_ws(",", *[f"c{i}" for i in range(g + 1)]) for g in range(TOP)])).alias("g", "path"))
    largest = paths.groupBy("g", "path").agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.max("n").alias("n"))
    return min((r["g"] + 1 for r in largest.collect() if r["n"] <= crowd), default=TOP)


def _dealt(words: DataFrame, depth: int, crowd: int) -> DataFrame:
    """word (bytes), n, state, key: each word once as a member (state -1), and for each key that it asks."""
    counts = [_count(g) for g in range(depth)]
    names = [f"c{g}" for g in range(depth)]
    base = words.select("word", "n", *[c.cast("int").alias(x) for c, x in zip(counts, names, strict=True)])

    def path(change: dict[int, int]) -> Column:
        return F.concat_ws(",", *[F.col(x) + change.get(g, 0) for g, x in enumerate(names)])

    asks = [F.struct(F.lit(0).alias("state"), path({}).alias("path"))]
    for g in range(depth):
        some = F.col(names[g]) > 0
        asks.append(F.when(some, F.struct(F.lit(1).alias("state"), path({g: -1}).alias("path"))))
        asks += [F.when(some, F.struct(F.lit(2).alias("state"), path({g: -1, later: 1}).alias("path"))) for later in range(g + 1, depth)]
    member = F.struct(F.lit(-1).alias("state"), path({}).alias("path"))
    sizes = words.select(F.concat_ws(",", *counts).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    heavy = sizes.filter(F.col("n") > crowd).select(F.col("path").alias("_path"), F.ceil(F.col("n") / crowd).cast("int").alias("_parts"))
    rows = base.select("word", "n", F.explode(F.filter(F.array(member, *asks), lambda x: x.isNotNull())).alias("x")).select(F.encode("word", "ISO-8859-1").alias("word"), "n", "x.state", "x.path")
    # At most one row for ``crowd`` words, so the keys that need parts are broadcast.
    rows = rows.join(F.broadcast(heavy), F.col("path") == F.col("_path"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word", "state"), F.col("_parts")).cast("int")
    all_ = F.sequence(F.lit(0), F.col("_parts") - 1)
    # A member is in one row of parts and all columns; who asks is in one column and all rows.
    cells = F.when(F.col("_parts") == 1, F.array(F.lit(""))).when(F.col("state") < 0, F.transform(all_, lambda i: F.concat_ws("-", F.lit(""), own, i))).otherwise(F.transform(all_, lambda i: F.concat_ws("-", F.lit(""), i, own)))
    return rows.withColumn("cell", F.explode(cells)).select("word", "n", "state", F.concat("path", "cell").alias("key"))


class _Trie:
    """Distinct rows of counts in order; a node of a level is the first row of those that begin alike."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        rows = counts[self.order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        self.start = np.append(np.flatnonzero(new), len(rows))
        self.rows = rows[new]
        differ = np.zeros(len(self.rows), np.int64)
        if len(self.rows) > 1:
            differ[1:] = (self.rows[1:] != self.rows[:-1]).argmax(1)
        #: For each level the rows that begin a node.
        self.nodes = [np.flatnonzero(np.r_[True, differ[1:] < g]) if len(self.rows) else np.zeros(0, np.int64) for g in range(counts.shape[1] + 1)]

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each node of a level, where its children begin and end among the next level's nodes."""
        first = np.searchsorted(self.nodes[level + 1], self.nodes[level])
        return first, np.append(first[1:], len(self.nodes[level + 1]))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from first to last (exclusive) of each pair, and which pair each is of."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which], which


def _descend(asks: _Trie, members: _Trie, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaves of ``asks`` and ``members`` (as row numbers) that the budget joins, with the state at the leaf.

    Level 0 is the key and level 1 the state of those who ask (0 among the members), so both
    are equal on a path; then come the letter groups. The stack holds slices of paths.
    """
    ask_down, member_down = [asks.children(g) for g in range(levels)], [members.children(g) for g in range(levels)]
    wide = int(max(asks.rows.max(initial=0), members.rows.max(initial=0))) + 3
    keyed = [np.zeros(0, np.int64)] * (levels + 1)
    for g in range(levels):
        first, last = member_down[g]
        parent = np.repeat(np.arange(len(first)), last - first)
        keyed[g + 1] = parent * wide + members.rows[members.nodes[g + 1], g] + 1
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int8))]
    while stack:
        level, q, m, t = stack.pop()
        if level == levels:
            yield asks.nodes[level][q], members.nodes[level][m], t
            continue
        first, last = ask_down[level]
        child, which = _spread(first[q], last[q])
        parent, t = m[which], t[which]
        count = asks.rows[asks.nodes[level + 1][child], level]
        found = []
        if level == 1:
            moves = [(0, count.astype(np.int8), np.ones(len(child), bool))]
            count = np.zeros_like(count)
        elif level == 0:
            moves = [(0, t, np.ones(len(child), bool))]
        else:
            moves = [(0, t, np.ones(len(child), bool)), (-1, np.ones_like(t), t == 0), (1, np.full_like(t, 2), t == 1)]
        for move, state, ok in moves:
            want = parent * wide + count + move + 1
            at = np.searchsorted(keyed[level + 1], want)
            hit = ok & (count + move >= 0) & (at < len(keyed[level + 1]))
            hit[hit] = keyed[level + 1][at[hit]] == want[hit]
            found.append((child[hit], at[hit], state[hit]))
        q, m, t = (np.concatenate(x) for x in zip(*found, strict=True))
        stack += [(level + 1, q[a : a + SLICE], m[a : a + SLICE], t[a : a + SLICE]) for a in range(0, len(q), SLICE)]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced byte tells two words apart."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


def _verified(words: list[bytes], size: np.ndarray, letters: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart; a is as long as b or longer by one."""
    ok = np.zeros(len(a), bool)
    long = (size[a] > WIDE) | (size[b] > WIDE)
    for i in np.flatnonzero(long):
        ok[i] = one_edit(words[a[i]], words[b[i]])
    rest = np.flatnonzero(~long)
    x, y = letters[a[rest]], letters[b[rest]]
    differ = x != y
    equal = size[a[rest]] == size[b[rest]]
    ok[rest[equal]] = differ[equal].sum(1) == 1
    x, y, differ = x[~equal], y[~equal], differ[~equal]
    after = np.arange(WIDE - 1) >= differ.argmax(1)[:, None]
    ok[rest[~equal]] = ~((x[:, 1:] != y[:, :-1]) & after).any(1)
    return ok


def _near(key: np.ndarray, words: list[bytes], n: np.ndarray, state: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Rows that have near words in this block: their numbers, how many, and the row of the most frequent one.

    The counts of the first ``depth`` groups are in the key, and what they cost in the state.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(len(words)), size)
    counts = np.zeros((len(words), GROUPS + 2), np.int64)
    counts[:, 0], counts[:, 1] = key, np.maximum(state, 0)
    counts[:, 2:] = np.bincount(row * GROUPS + _GROUP[flat], minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    counts[:, 2 : 2 + depth] = 0
    letters = np.zeros((len(words), WIDE), np.uint8)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    short = place < WIDE
    letters[row[short], place[short]] = flat[short]
    asking, member = np.flatnonzero(state >= 0), np.flatnonzero(state < 0)
    best_first = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[best_first] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    if len(asking) and len(member):
        asks, members = _Trie(counts[asking]), _Trie(counts[member])
        for q, m, t in _descend(asks, members, GROUPS + 2):
            each = np.diff(members.start)[m]
            # A leaf against a leaf, a row of the asking one at a time.
            ask, of = _spread(asks.start[q], asks.start[q + 1])
            for lo in _cuts(each[of]):
                other, by = _spread(members.start[m[of[lo]]], members.start[m[of[lo]] + 1])
                a, b = asking[asks.order[ask[lo][by]]], member[members.order[other]]
                once = (t[of[lo]][by] > 0) | (rank[a] < rank[b])
                a, b = a[once], b[once]
                ok = _verified(words, size, letters, a, b)
                a, b = a[ok], b[ok]
                near += np.bincount(a, minlength=len(words)) + np.bincount(b, minlength=len(words))
                np.minimum.at(best, a, rank[b])
                np.minimum.at(best, b, rank[a])
    got = np.flatnonzero(near)
    return got, near[got], np.array(best_first, np.int64)[best[got]] if len(got) else got


def _cuts(n: np.ndarray) -> Iterator[slice]:
    """Stretches whose numbers sum to about SLICE (one number at least)."""
    at, upto = 0, np.cumsum(n)
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        yield slice(at, stop)
        at = stop


def neighbours(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n_near, best (n and word of the most frequent near word; ties to the smaller word) of words that have near ones. words: word, n; distinct."""
    depth = _depth(words, crowd)
    dealt = _dealt(words, depth, crowd)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(x.num_rows for x in held) >= BLOCK:
                whole = pa.concat_tables(held)
                keys = whole.column("key").to_numpy(zero_copy_only=False)
                # All rows of the last key may not be here yet.
                stop = int(np.argmax(keys == keys[-1]))
                held = [whole.slice(stop)]
                yield from found(whole.slice(0, stop))
        if held:
            yield from found(pa.concat_tables(held))

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        row, near, best = _near(key, words := t.column("word").to_pylist(), n := t.column("n").to_numpy(), t.column("state").to_numpy().astype(np.int64), depth)
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in row], pa.binary()), pa.array(near), pa.array(n[best]), pa.array([words[i] for i in best], pa.binary())], names=["word", "n_near", "best_n", "best"])

    parted = dealt.repartition(partitions(words.sparkSession), "key").sortWithinPartitions("key")
    each = parted.select("key", "word", "n", "state").mapInArrow(work, "word binary, n_near bigint, best_n bigint, best binary")
    chosen = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return chosen.select(text("word").alias("word"), "n_near", (-F.col("b.n")).alias("best_n"), text(F.col("b.w")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last word of each chain of forms.

    Each round replaces a word's target by its target's target; counts double along a chain,
    so chains have at most 63 forms and six rounds reach any end.
    """
    held = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = held.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        moved = stored(held.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        released(held)
        held = moved
        if moved.filter("_moved").isEmpty():
            return moved.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, form, form_n, n_near, root.

    Words are near if exactly one inserted, deleted or replaced code point tells them apart;
    n_near counts all near words. The form is the near word of largest n (ties: the smallest
    in code-point order) if its n is at least ``ratio`` (2 or more) times the word's own, else
    null; the root follows forms to the last word and is the word itself without a form.
    Words hold code points below 256 only; others would be no words of ``runs``. Rows of one
    word are an error of the caller; ``vocabulary`` gives each once. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("the ratio is at least 2: chains of forms would not end soon")
    kept = stored(words.select("word", "n"), "words")
    near = stored(neighbours(kept, crowd), "near")
    freed(words.sparkSession)
    joined = kept.join(near.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    enough = F.col("best_n") >= ratio * F.col("n")
    rows = joined.select("word", "n", F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = 97, least_length: int = 5, least_count: int = 3, ratio: int = 2, crowd: int = CROWD) -> DataFrame:
    """``variants`` of the words of whole documents; with ``every``, one run in so many loses a letter first (see ``damaged``).

    Null and empty texts have no words; repeated rows count as often as they come; a null id
    takes part in the damage as an empty string. An empty table gives no rows.
    """
    found = runs(docs, id_col, text_col)
    words = found.select((damaged(F.col("_id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return variants(vocabulary(words, least_length, least_count), ratio, crowd)
