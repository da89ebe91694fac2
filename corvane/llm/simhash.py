"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits. Two that differ in at most 2 bits differ in at most 1 bit of the
upper half or in none of the lower half; two that differ in at most 3 differ in at most 1 bit
of either half. So the table of fingerprints is indexed by each half; a lookup enumerates the
Hamming balls of those radii around a fingerprint's halves (34 or 66 keys), fetches the
table's matches and verifies the whole distance.

Only distinct fingerprints are indexed; copies share theirs. A half that many fingerprints
share would make its bucket quadratic. At 2 bits, fingerprints of such buckets are matched by
balls of radius 1 around the whole 64 bits instead: two within 2 bits have a centre in common,
and no centre has more than 65 fingerprints. At 3 bits such buckets are parted by the four
bytes of the other half, one of which two within 3 bits have in common. Nothing is dropped.

Fingerprints of single words lie closer together than those of shingles, and more of their
halves are crowded the more documents there are. ``ball_links`` therefore gives all of them
the balls of radius 1 around the whole 64 bits: 65 rows a fingerprint, whatever its halves.

``classes`` links fingerprints alone. ``representatives`` links documents whose five-word
shingles have a Jaccard similarity of 0.8 or more. Their candidates are fingerprints of single
words within 2 bits, and, since a fifth of such pairs or more lie beyond any radius that can be
enumerated, documents that share one of BANDS pairs of min-hashes: at 0.8 all but one pair in
3,000 do.

Components come from randomised contraction: every round each node joins the neighbour of
least random rank, edges are rewritten and made distinct, and expected rounds are
logarithmic in the number of nodes whatever the shape of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, freed, released, stored, text_or_empty

#: A half shared by more distinct fingerprints than this is matched by whole balls.
BUCKET = 64
#: Documents of one key that meet the same document.
STAR = 1000
#: Pairs of min-hashes of the sketch that are keys of their own; also each with the next, for keys that unlike documents share.
BANDS = 8
#: Documents of a block of a large key; any two blocks of a key meet in a task.
BLOCK = 2048
#: Documents worked on at once.
SLICE = 256
#: Min-hashes of a document's shingles that travel with it, and how many two documents must have in common to be compared in full: at similarity 0.8 fewer than 7 of 16 agree once in 4,000 pairs.
SKETCH, SHARED = 16, 7
_TIMES = (np.arange(SKETCH, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles; 0 if it has no word. Fewer words than a shingle are one shingle."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    # bytes.split() parts words at \x09-\x0D and \x20, as the operator does.
    n = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(n + 1) - 1
    last = stop[shingle - 1 :] if len(words) >= shingle else stop[-1:]
    first = (stop - n)[: len(last)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """_id, _fp (the fingerprint as a signed long), read from whole texts. Null texts count as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["_id", "_fp"])

    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return base.mapInArrow(hashed, f"_id {base.schema['_id'].dataType.simpleString()}, _fp bigint")


def _centres() -> Column:
    """_fp and the 64 fingerprints at 1 bit from it."""
    return F.array(F.col("_fp"), *[F.col("_fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("bigint")) for i in range(64)])


def links(prints: DataFrame, bucket: int = BUCKET, radius: int = 2) -> DataFrame:
    """Pairs u < v that connect all fingerprints within ``radius`` (2 or 3) bits of one another.

    prints: distinct fingerprints in column _fp. At 3 bits every such pair is returned. At 2,
    every such pair outside crowded buckets; of one centre in a crowded bucket, each
    fingerprint is paired with the least one (all of a centre are within 2 bits of each
    other), which connects the same ones.
    """
    if radius not in (2, 3):
        raise ValueError("radius is 2 or 3")
    upper, lower = F.shiftrightunsigned("_fp", 32), F.col("_fp").bitwiseAND(0xFFFFFFFF)
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(32)])
    half = lambda n, key: F.struct(F.lit(n).alias("half"), key.alias("key"))
    around = lambda n, key: F.transform(flips, lambda f: half(n, key.bitwiseXOR(f)))
    table = prints.select("_fp", F.explode(F.array(half(0, upper), half(1, lower))).alias("k")).select("_fp", "k.half", "k.key")
    crowded = cut(table.groupBy("half", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("half", "key"))
    thin = table.join(crowded, ["half", "key"], "left_anti")
    balls = F.array_append(around(0, upper), half(1, lower)) if radius == 2 else F.concat(around(0, upper), around(1, lower))
    ball = prints.select(F.col("_fp").alias("_q"), F.explode(balls).alias("k")).select("_q", "k.half", "k.key")
    verified = F.bit_count(F.col("_fp").bitwiseXOR(F.col("_q"))) <= radius
    found = thin.join(ball, (thin["half"] == ball["half"]) & (thin["key"] == ball["key"]) & (F.col("_q") < F.col("_fp")) & verified).select(F.col("_q").alias("u"), F.col("_fp").alias("v"))
    # Members of crowded buckets, and whatever is within the ball of their key.
    near = ball.join(crowded, ["half", "key"], "left_semi")
    if radius == 2:
        near = near.select(F.col("_q").alias("_fp")).distinct()
        stars = near.select("_fp", F.explode(_centres()).alias("centre"))
        least = stars.groupBy("centre").agg(F.min("_fp").alias("u"), F.collect_list("_fp").alias("all")).filter(F.size("all") > 1)
        crowd = least.select("u", F.explode("all").alias("v")).filter("u < v")
    else:
        bytes_of = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("i"), F.call_function("shiftrightunsigned", F.when(F.col("half") == 0, F.col(c).bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned(c, 32)), i * 8).bitwiseAND(255).alias("byte"))))
        held = table.join(crowded, ["half", "key"], "left_semi").select("_fp", "half", "key", bytes_of("_fp").alias("b")).select("_fp", "half", "key", "b.*")
        asks = near.select("_q", "half", "key", bytes_of("_q").alias("b")).select("_q", "half", "key", "b.*")
        crowd = held.join(asks, ["half", "key", "i", "byte"]).filter((F.col("_q") < F.col("_fp")) & verified).select(F.col("_q").alias("u"), F.col("_fp").alias("v"))
    return found.unionByName(crowd).distinct()


def ball_links(prints: DataFrame) -> DataFrame:
    """All pairs u < v of fingerprints within 2 bits of one another: they have a centre within 1 bit of both in common, and no centre has more than 65.

    prints: distinct fingerprints in column _fp.
    """
    stars = prints.select("_fp", F.explode(_centres()).alias("centre"))
    balls = stars.groupBy("centre").agg(F.array_sort(F.collect_list("_fp")).alias("all")).filter(F.size("all") > 1)
    met = balls.select(F.posexplode("all").alias("i", "u"), "all").select("u", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("v"))
    return met.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v longs): nodes have the same root if and only if a path joins them."""
    both = cut(edges.filter("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct())
    whole = both.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    turn = 0
    while not both.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
        nearest = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"))
        chosen = cut(nearest.select("u", F.when(rank("v") < rank("u"), F.col("v")).otherwise(F.col("u")).alias("to")))
        whole = cut(whole.join(chosen, whole["root"] == chosen["u"], "left").select("node", F.coalesce("to", "root").alias("root")))
        half = both.join(chosen, "u").select(F.col("to").alias("a"), "v")
        other = chosen.select(F.col("u").alias("v"), F.col("to").alias("b"))
        both = cut(half.join(other, "v").select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    return whole


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most 2 bits).

    Null texts count as empty; all texts without words have fingerprint zero and are linked
    like any other. A null id is the component's id only if no member has another. Repeated
    rows stay. Components do not need an order of rows, so ties cannot arise.
    """
    each = cut(fingerprints(docs, id_col, text_col, shingle))
    prints = cut(each.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(links(prints.select("_fp"))).withColumnRenamed("node", "_fp")
    rooted = prints.join(roots, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    smallest = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    known = rooted.select("_fp", "root").join(smallest, "root").select("_fp", "component_id")
    return each.join(known, "_fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int) -> np.ndarray:
    """32-bit hashes of the word shingles of a text, sorted, each once; fewer words than a shingle are one, none are none."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint32)
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(b" ".join(parts[i : i + words])) for i in range(max(1, len(parts) - words + 1))), np.uint32))


def shingle_sketch(text: str, words: int) -> np.ndarray:
    """SKETCH min-hashes (16 bits of each) of a text's word shingles; zeros without words."""
    s = shingle_set(text, words)
    if not len(s):
        return np.zeros(SKETCH, np.uint16)
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 65536):
        h = s[at : at + 65536, None] * _TIMES
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        least = np.minimum(least, h.min(0))
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def _promising(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """Of pairs a, b those whose sketches have SHARED min-hashes in common, with their number (n)."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SKETCH) for i in (2, 3))
            n = (x == y).sum(1).astype(np.int32)
            ok = pa.array(n >= SHARED)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(n).filter(ok)], names=["a", "b", "n"])

    of = lambda c, s: each.select(F.col("doc").alias(c), F.col("sketch").alias(s))
    return pairs.join(of("a", "sa"), "a").join(of("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(kept, "a bigint, b bigint, n int")


def _keys(each: DataFrame) -> DataFrame:
    """doc, key: the fingerprint, and each band of the sketch alone and with the next; a text without words has the first only."""
    band = lambda i: F.substring("sketch", 4 * (i % BANDS) + 1, 4)
    single = [F.xxhash64(F.lit(i), band(i)) for i in range(BANDS)]
    double = [F.xxhash64(F.lit(i), band(i), band(i + 1)) for i in range(BANDS)]
    own = F.array(F.xxhash64("fp"))
    wordless = F.col("sketch") == F.lit(bytes(2 * SKETCH))
    return each.select("doc", F.explode(F.when(wordless, own).otherwise(F.array_distinct(F.concat(own, F.array(*single, *double))))).alias("key"))


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs a, b that connect the documents (doc) of each key: with the least of STAR or so, and those with the least of all."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Powers of two: the parts of keys of different sizes lie within one another, so that their least documents are mostly the same.
    parts = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / STAR))).cast("bigint"))
    dealt = rows.join(counts, "key").withColumn("part", F.pmod("doc", parts))
    heads = dealt.groupBy("key", "part").agg(F.min("doc").alias("head"))
    tops = heads.groupBy("key").agg(F.min("head").alias("top"))
    own = dealt.join(heads, ["key", "part"]).select(F.col("head").alias("a"), F.col("doc").alias("b"))
    return own.unionByName(heads.join(tops, "key").select(F.col("top").alias("a"), F.col("head").alias("b"))).filter("a <> b")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc, s: the shingle sets of documents (doc, text), each once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, words).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["doc", "s"])

    return docs.mapInArrow(sets, "doc bigint, s binary").dropDuplicates(["doc"])


def _blocks(t: pa.Table) -> tuple[np.ndarray, ...]:
    """doc, root and sketch of the rows of a pair of blocks, and the places of either block; both are the same where a block meets itself."""
    i, j, own, doc, root = (t.column(c).to_numpy() for c in ("i", "j", "own", "doc", "root"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
    return doc, root, sketch, np.flatnonzero(own == i), np.flatnonzero(own == j)


def _links_within(rows: DataFrame, each: DataFrame, roots: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """a, b: similar documents that share a key (``rows``: key, doc), as many as connect all such of different roots (node, root; others are their own).

    All pairs of a key whose sketches share SHARED min-hashes and whose roots differ are
    compared in full, in the tasks: those of a key of over BLOCK documents by pairs of blocks.
    First by sketches alone, so that shingle sets are sent for documents of such pairs only.
    """
    rooted = rows.join(roots, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    open_ = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    dealt = rooted.join(open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    sent = dealt.join(each.select("doc", "sketch"), "doc").select("key", "doc", "root", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sent = sent.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "root", "sketch")

    def met(t: pa.Table) -> pa.Table:
        doc, root, sketch, left, right = _blocks(t)
        found, columns = np.zeros(len(doc), bool), np.ascontiguousarray(sketch[right].T)
        for at in range(0, len(left), SLICE):
            part = left[at : at + SLICE]
            n = np.zeros((len(part), len(right)), np.uint8)
            for c, column in enumerate(columns):
                n += sketch[part, c, None] == column
            alike = (n >= SHARED) & (root[part, None] != root[right])
            found[part] |= alike.any(1)
            found[right] |= alike.any(0)
        return t.filter(pa.array(found))

    def compared(t: pa.Table) -> pa.Table:
        doc, root, sketch, left, right = _blocks(t)
        sets = [np.frombuffer(x, np.uint32) for x in t.column("s").to_pylist()]
        size = np.array([len(x) for x in sets])
        begin = np.cumsum(size) - size
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        root, has, out = np.unique(root, return_inverse=True)[1], np.zeros(len(values), bool), []
        for x in left.tolist():
            y = right[root[right] != root[x]]
            y = y[(sketch[y] == sketch[x]).sum(1) >= SHARED]
            y = y[np.minimum(size[y], size[x]) >= least * np.maximum(size[y], size[x])]
            for at in range(0, len(y), SLICE):
                some = y[at : at + SLICE]
                mine = code[begin[x] : begin[x] + size[x]]
                has[mine] = True
                upto = np.concatenate([[0], np.cumsum(size[some])])
                held = np.concatenate([[0], np.cumsum(has[code[np.repeat(begin[some] - upto[:-1], size[some]) + np.arange(upto[-1])]])])
                has[mine] = False
                common = held[upto[1:]] - held[upto[:-1]]
                for z in some[common >= least * (size[x] + size[some] - common)].tolist():
                    if root[z] != root[x]:
                        out.append((doc[x], doc[z]))
                        root[root == root[z]] = root[x]
        a, b = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1).T
        return pa.table({"a": a, "b": b})

    kind = "key bigint, i int, j int, own int, doc bigint, root bigint, sketch binary"
    alike = stored(sent.groupBy("key", "i", "j").applyInArrow(met, kind), "alike")
    named = stored(alike.select(F.col("doc").alias("named")).distinct(), "named")
    held = stored(_sets(docs.join(named, F.col("doc") == F.col("named"), "left_semi"), words), "sets")
    out = stored(alike.join(held, "doc").groupBy("key", "i", "j").applyInArrow(compared, "a bigint, b bigint").distinct(), "within")
    released(alike, named, held)
    return out


def similar_pairs(docs: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """Of pairs a, b (of column doc of ``docs``: doc, text) those whose word shingles have a Jaccard similarity of ``least`` or more."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common >= least * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    # Written first, so that the planner knows whether it is small.
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("named")).distinct(), "named")
    held = stored(_sets(docs.join(named, F.col("doc") == F.col("named"), "left_semi"), words), "sets")
    freed(docs.sparkSession)
    one = lambda c, s: held.select(F.col("doc").alias(c), F.col("s").alias(s))
    met = pairs.join(one("a", "sa"), "a").join(one("b", "sb"), "b").select("a", "b", "sa", "sb")
    out = stored(met.mapInArrow(compared, "a bigint, b bigint"), "similar")
    released(held, named)
    return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 1, radius: int = 2, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near copies the document of smallest id.

    Near copies have a Jaccard similarity of ``least`` or more of their shingles of ``words``
    words; groups are connected by such pairs. Candidates have fingerprints (of ``shingle``
    words) within ``radius`` bits, or share a band of the sketch. Pairs whose sketches of SKETCH
    min-hashes share SHARED or more are compared in full: first every document with the least
    of its keys (by a hash) that is most alike, then the others of those, and then all pairs
    of each key that this has not joined yet.
    Null texts count as empty; empty texts are near copies of one another.
    A null id stays only in a group without others. Rows of the same id and text are one
    document: they stay or go together. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    key = lambda i, t: F.xxhash64(F.coalesce(i.cast("string"), F.lit("\0")), t)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            sketch = pa.array([shingle_sketch(t, words).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), sketch], names=["doc", "id", "fp", "sketch"])

    kind = base.schema["_id"].dataType.simpleString()
    rows = base.select(key(F.col("_id"), F.col("_text")).alias("doc"), "_id", "_text").mapInArrow(hashed, f"doc bigint, id {kind}, fp bigint, sketch binary")
    each = stored(rows.dropDuplicates(["doc"]), "prints")
    prints = cut(each.groupBy(F.col("fp").alias("_fp")).agg(F.min("doc").alias("doc")))
    near = cut(ball_links(prints.select("_fp")) if radius == 2 else links(prints.select("_fp"), radius=radius))
    head = lambda f, d: prints.select(F.col("_fp").alias(f), F.col("doc").alias(d))
    across = near.join(head("u", "a"), "u").join(head("v", "b"), "v").select("a", "b")
    # Documents of one fingerprint meet those of each near one too.
    shared = cut(each.groupBy(F.col("fp").alias("_fp")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_fp"))
    crowd = lambda c: near.join(shared, F.col(c) == F.col("_fp"), "left_semi")
    beside = crowd("u").unionByName(crowd("v")).distinct().select(F.xxhash64(F.lit("near"), "u", "v").alias("key"), F.explode(F.array("u", "v")).alias("_fp"))
    keys = stored(_keys(each).unionByName(beside.join(each.select("doc", "fp"), F.col("fp") == F.col("_fp")).select("doc", "key")), "keys")
    met = _stars(keys).unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(_promising(met, each), "pairs")
    freed(docs.sparkSession)
    texts = base.select(key(F.col("_id"), F.col("_text")).alias("doc"), F.col("_text").alias("text"))
    chosen = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "chosen")
    edges = similar_pairs(texts, chosen, words, least)
    linked = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    root = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    apart = pairs.join(chosen, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = stored(apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    more = similar_pairs(texts, rest, words, least)
    some = components(edges.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    last = _links_within(keys, each, some, texts, words, least)
    roots = components(edges.unionByName(more).unionByName(last).select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = each.select("doc", "id").join(roots, F.col("doc") == F.col("node"))
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc")).alias("x")).select("root", F.col("x.doc").alias("stays"))
    gone = stored(rooted.join(stays, "root").filter("doc <> stays").select(F.col("doc").alias("_gone")), "gone")
    released(each, keys, pairs, chosen, edges, rest, more, last)
    freed(docs.sparkSession)
    return docs.join(gone, key(F.col(id_col), text_or_empty(text_col)) == F.col("_gone"), "left_anti")
