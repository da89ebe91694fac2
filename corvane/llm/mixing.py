"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are put in a random order that depends on a seed and the documents
alone, and laid end to end, once for every whole pass and then as far as the target reaches:
the source's line of words. The line is dealt in blocks of ``block_words``. The root of the
tree holds how many blocks each source gives; every node splits its counts between two
halves of the output shards by one multivariate-hypergeometric draw, down to single shards.
So each shard gets exact quotas that sum to the sources' blocks, is a fair sample of the
whole mix, and its blocks of a source are a stretch of that source's line which no other
shard has. Within a shard, rows are put in a random order.

A multivariate draw is itself made by halves: the blocks that a node gives to its left half
are drawn between the lower and the upper half of the sources, then within each. A walk from
the root to a block's shard thus needs the counts of the source's own groups and their
neighbours only (a row of the source's table, twice the logarithm of the number of sources)
and draws that depend on the seed and the node: no task has to see another's, and no list of
the sources is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, rows_as_struct, running, text_or_empty

WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a block, blocks of a shard, and blocks in all, beyond which blocks are made larger: draws are exact up to there.
BLOCK_WORDS, SHARD_BLOCKS, MOST_BLOCKS = 1024, 4096, 1 << 29
#: Documents that share a bucket of the random order; running sums go over buckets first, then within each.
BUCKET_ROWS = 250


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target of each row of ``sizes`` (source, source_size).

    Sources in order of code points, null last, weigh ``weights`` in turn. A target is its
    source's weight times one level, or ``cap`` times the source's size if that is less; the
    level is the one at which all targets sum to all sizes, which is where repeated
    resharing of the excess ends. _place numbers the sources in their order.
    """
    ordered = running(sizes, [F.col("source").asc_nulls_last()])
    ordered = ordered.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")).cast("bigint"))
    # In order of size per weight, sources up to some point are capped; the level that the rest then share tells where: it falls from the right point on.
    room = ordered.withColumn("_room", F.col("source_size") / F.col("weight")).withColumnRenamed("_place", "_number")
    ranked = cut(running(room, [F.col("_room").asc(), F.col("source").asc_nulls_last()], {"_capped": F.col("source_size") * cap, "_weights": F.col("weight")}))
    everything = ranked.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weight"))
    level = (F.col("_all") - F.col("_capped")) / (F.col("_weight") - F.col("_weights"))
    levels = ranked.crossJoin(F.broadcast(everything)).withColumn("_level", level)
    best = levels.filter(F.col("_level") * F.col("weight") <= F.col("source_size") * cap).agg(F.max("_level").alias("_best"))
    return ranked.crossJoin(F.broadcast(best)).select("source", "source_size", F.least(F.col("_best") * F.col("weight"), (F.col("source_size") * cap).cast("double")).alias("target"), F.col("_number").alias("_place"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables: the sources' source, source_size, target and number (_place); and one row per document: _id, _source, size, source_size, target, whole (passes it is in in full), extra (words of the last pass), start (its place in the line's pass).

    Null texts have size 0 and are never taken. Documents of equal random order go by id,
    then by size; rows repeated in full are documents of their own.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("size"), *([rows_as_struct(docs)] if carry else []))
    base = base.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    slim = cut(base.select("_id", "_source", "size", "_order"))
    buckets = max(1, slim.count() // BUCKET_ROWS)
    bucket = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32))
    sums = cut(slim.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("size").alias("_words")))
    by_source = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    sources = cut(targets(by_source, weights, cap))
    aims = sources.select(F.col("source").alias("_a"), "source_size", "target")
    line = cut(running(sums, [F.col("_source").asc_nulls_last(), F.col("_bucket").asc()], {"_upto": F.col("_words")}).drop("_place"))
    heads = line.groupBy(F.col("_source").alias("_s")).agg(F.min("_upto").alias("_head")).join(aims, F.col("_s").eqNullSafe(F.col("_a")))
    offsets = line.join(heads, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_before", F.col("_upto") - F.col("_head"))
    offsets = offsets.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_before", "source_size", "target")
    rows = (base if carry else slim).withColumn("_bucket", bucket)
    joined = rows.join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", F.col("_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("bigint"))
    left = F.round("target").cast("bigint") - passes * F.col("source_size")
    return sources, joined.select("_id", "_source", "size", "source_size", "target", start.alias("start"), passes.alias("whole"), left.alias("_left"), "_order", *(["_row"] if carry else [])).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("start"))))


def group_counts(sources: DataFrame, block_words: int) -> DataFrame:
    """_place and path of every source. path: blocks of the lower and the upper half of each group of sources that the source is in, from all sources down to pairs."""
    blocks = sources.select("_place", F.ceil(F.round("target") / block_words).cast("bigint").alias("blocks"))
    levels = max(1, (max(1, sources.count()) - 1).bit_length())
    at = lambda level: F.expr(f"shiftright(_place, {level})")
    groups = blocks.select("blocks", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), at(n).alias("group")) for n in range(levels)])).alias("x")).groupBy("x.level", "x.group").agg(F.sum("blocks").alias("n"))
    halves = F.array(*[F.struct(F.lit(n).alias("level"), (at(n + 1) * 2 + side).alias("group")) for n in reversed(range(levels)) for side in (0, 1)])
    asked = blocks.select("_place", F.posexplode(halves).alias("i", "x")).select("_place", "i", "x.level", "x.group")
    counted = asked.join(groups, ["level", "group"], "left")
    return counted.groupBy("_place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("path"))


class Tree:
    """Walks down the splitting tree of one mix. What nodes give to their left half is kept for the next walk."""

    def __init__(self, shards: int, seed: int, most: int = 1 << 16):
        self.shards, self.seed, self.most = shards, seed, most
        self.kept: dict[tuple[int, int, int], tuple[tuple[int, ...], tuple[int, ...], int]] = {}

    def halves(self, low: int, high: int, source: int, path: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int]:
        """The path counts of a node's left and right half, and the blocks of the source that go left."""
        key = (low, high, source)
        if (known := self.kept.get(key)) is not None:
            return known
        middle = (low + high) // 2
        take = (path[0] + path[1]) * (middle - low) // (high - low)
        left = []
        levels = len(path) // 2
        for n in range(levels):
            level = levels - 1 - n
            a, b = path[2 * n], path[2 * n + 1]
            rng = np.random.default_rng([self.seed, low, high, level, source >> (level + 1)])
            lower = int(rng.hypergeometric(a, b, take)) if a and take else 0
            left += [lower, take - lower]
            take = left[-1] if source >> level & 1 else lower
        if len(self.kept) >= self.most:
            self.kept.clear()
        out = self.kept[key] = tuple(left), tuple(x - y for x, y in zip(path, left, strict=True)), take
        return out

    def shard_of(self, block: int, source: int, path: tuple[int, ...]) -> int:
        """The shard that holds a block (its number in the source's line)."""
        low, high = 0, self.shards
        while high - low > 1:
            left, right, mine = self.halves(low, high, source, path)
            middle = (low + high) // 2
            if block < mine:
                high, path = middle, left
            else:
                block -= mine
                low, path = middle, right
        return low


def sized(words: int, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> tuple[int, int]:
    """Words of a block and number of shards of a mix of so many words."""
    block_words = max(block_words, -(-words // MOST_BLOCKS))
    return block_words, max(1, -(-words // (block_words * shard_blocks)))


def draw(sources: DataFrame, planned: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> DataFrame:
    """The mix: one row per document and shard piece: the columns of ``planned`` with pass, first_word, end_word (of the document), shard, position.

    A document that lies across the edge of a shard's stretch is in both, each with its own
    words: quotas are exact. ``position`` is a random key; a shard is read in its order.
    """
    words = sources.agg(F.sum(F.round("target").cast("bigint"))).first()[0] or 0
    block_words, shards = sized(words, block_words, shard_blocks)
    paths = sources.select("_place", F.col("source").alias("_s")).join(group_counts(sources, block_words), "_place")
    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("whole")), lambda p: F.struct(p.alias("pass"), F.when(p < F.col("whole"), F.col("size")).otherwise(F.col("extra")).alias("words"))), lambda x: x["words"] > 0)
    turns = planned.select("*", F.explode(passes).alias("_p")).select(*planned.columns, F.col("_p.pass").alias("_pass"), F.col("_p.words").alias("_words"))
    turns = turns.withColumn("_line", F.col("_pass") * F.col("source_size") + F.col("start"))
    turns = turns.join(paths, F.col("_source").eqNullSafe(F.col("_s")))

    @F.pandas_udf("array<struct<shard:int,first_word:bigint,end_word:bigint>>")
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tree = Tree(shards, seed)

        def one(source: int, path: np.ndarray, line: int, words: int) -> list[dict]:
            out: list[dict] = []
            root = tuple(path.tolist())
            for block in range(line // block_words, (line + words - 1) // block_words + 1):
                shard = tree.shard_of(block, source, root)
                a, b = max(line, block * block_words) - line, min(line + words, (block + 1) * block_words) - line
                if out and out[-1]["shard"] == shard:
                    out[-1]["end_word"] = b
                else:
                    out.append({"shard": shard, "first_word": a, "end_word": b})
            return out

        for columns in batches:
            yield pd.Series([one(*x) for x in zip(*columns, strict=True)])

    split = turns.withColumn("_piece", F.explode(pieces("_place", "path", "_line", "_words")))
    return split.select(*planned.columns, F.col("_pass").alias("pass"), F.col("_piece.shard").alias("shard"), F.col("_piece.first_word").alias("first_word"), F.col("_piece.end_word").alias("end_word"), F.xxhash64(F.lit(seed), "_order", F.col("_pass"), F.col("_piece.shard")).alias("position"))


def taken(planned: DataFrame, mix: DataFrame) -> DataFrame:
    """Documents with the words that the mix takes of each and the shards that hold it, none included: _id, size, source_size, target, taken, shards."""
    nothing = planned.filter("size * whole + extra = 0").select("_id", "size", "source_size", "target")
    pieces = mix.select("_id", "_source", "size", "source_size", "target", "start", (F.col("end_word") - F.col("first_word")).alias("words"), "shard")
    return nothing.select("_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("shards")).unionByName(
        pieces.groupBy("_id", "_source", "start", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.countDistinct("shard").alias("shards")).select("_id", "size", "source_size", "target", "taken", "shards")
    )


#: A word with the white space after it, and before it where it is a text's first: pieces of a text put together are the text.
SPACED = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def words_between(text: Column, first: Column, end: Column) -> Column:
    """The words first (from 0) up to end (exclusive) of a text, with the white space that belongs to them."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)), (first + 1).cast("int"), (end - first).cast("int")), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", pieces: bool = False, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11, **kw) -> DataFrame:
    """The mix as rows of ``docs``, shard by shard and shuffled within each: a document appears once for each pass and shard piece, its text cut to the piece's words where it is not whole.

    The rows of a shard are in one partition, in order of position: written, they are in one file.
    With ``pieces``, columns _shard, _position, _pass, _first_word and _end_word say which
    piece a row is. Documents without words are in no mix.
    """
    sources, planned = plan(docs, id_col, text_col, source_col, seed=seed, carry=True, **kw)
    mix = draw(sources, planned, block_words, shard_blocks, seed)
    text = F.when((F.col("first_word") == 0) & (F.col("end_word") == F.col("size")), F.col(f"_row.`{text_col}`")).otherwise(words_between(F.col(f"_row.`{text_col}`"), F.col("first_word"), F.col("end_word")))
    names = mix.schema["_row"].dataType.names
    out = {text_col: text} | ({length_col: F.length(text).cast("bigint")} if length_col in names else {})
    shuffled = mix.repartition("shard").sortWithinPartitions("shard", "position")
    which = [F.col(c).alias(f"_{c}") for c in ("shard", "position", "pass", "first_word", "end_word")] if pieces else []
    return shuffled.select(*[(out.get(c, F.col(f"_row.`{c}`"))).alias(c) for c in names], *which)
