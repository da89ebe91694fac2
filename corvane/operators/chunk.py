"""Cutting texts into chunks, as built-in expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import paragraphs, sentences, strip

# Characters of a chunk, of the overlap, and of the shortest text and chunk.
SIZE, OVERLAP, LEAST = 512, 50, 100


def sliding(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Stripped cuts of ``size`` characters every ``size`` - ``overlap``; those under ``least`` go. An overlap of 0 is allowed."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    cuts = F.transform(starts, lambda i: strip(F.substring(text, i + 1, F.lit(size))))
    return F.when(F.length(text) >= least, F.filter(cuts, lambda c: F.length(c) >= least)).otherwise(F.array().cast("array<string>"))


def section_label(text: Column) -> Column:
    """By the first 200 characters; the first rule that holds."""
    head = F.substring(F.lower(text), 1, 200)
    return (
        F.when(head.contains("abstract") | head.startswith("background"), "abstract")
        .when(head.contains("introduction"), "introduction")
        .when(head.contains("method") | head.contains("material"), "methods")
        .when(head.contains("result"), "results")
        .when(head.contains("discussion"), "discussion")
        .when(head.contains("conclusion") | head.contains("summary"), "conclusion")
        .otherwise("body")
    )


def _flushed(out: Column, piece: Column, least: int) -> Column:
    return F.when(F.length(piece) >= least, F.concat(out, F.array(piece))).otherwise(out)


def packed_sentences(text: Column, size: int = SIZE, least: int = LEAST) -> Column:
    """Sentences joined while they fit ``size``; pieces under ``least`` go; a longer sentence stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["cur"]) + F.length(x) + 1 <= size
        return F.struct(
            F.when(fits, s["out"]).otherwise(_flushed(s["out"], s["cur"], least)).alias("out"),
            F.when(fits & (s["cur"] != ""), F.concat(s["cur"], F.lit(" "), x)).otherwise(x).alias("cur"),
        )

    return F.aggregate(sentences(text), start, step, lambda s: _flushed(s["out"], s["cur"], least))


def semantic(text: Column, size: int = SIZE, least: int = LEAST) -> Column:
    """Paragraphs joined by blank lines while they fit; a longer paragraph is packed by sentences.

    A running chunk under ``least`` outlives a long paragraph and joins a later one; it is
    dropped where a paragraph starts a new chunk, and at the end.
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(s: Column, p: Column) -> Column:
        long = F.length(p) > size
        fits = F.length(s["cur"]) + F.length(p) + 2 <= size
        ready = F.length(s["cur"]) >= least
        flushed = _flushed(s["out"], strip(s["cur"]), least)
        return F.struct(
            F.when(long, F.concat(F.when(ready, flushed).otherwise(s["out"]), packed_sentences(p, size, least))).when(fits, s["out"]).otherwise(flushed).alias("out"),
            F.when(long, F.when(ready, F.lit("")).otherwise(s["cur"])).when(fits & (s["cur"] != ""), F.concat(s["cur"], F.lit("\n\n"), p)).otherwise(p).alias("cur"),
        )

    chunks = F.aggregate(paragraphs(text), start, step, lambda s: _flushed(s["out"], strip(s["cur"]), least))
    return F.when(F.length(text) >= least, chunks).otherwise(F.array().cast("array<string>"))


def explode_chunks(df: DataFrame, key: str, chunks: Column, keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: ``key``, chunk_no from 0, chunk_id (key_no), chunk_text. The same ids on every run."""
    return df.select(key, *(keep or []), F.posexplode(chunks).alias("chunk_no", "chunk_text")).withColumn("chunk_id", F.concat_ws("_", key, "chunk_no"))


def with_context(chunks: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Chunks with the end of the one before and the beginning of the one after, empty at the edges, and their label."""
    w = Window.partitionBy(key).orderBy("chunk_no")
    prev, after = F.lag("chunk_text").over(w), F.lead("chunk_text").over(w)
    return (
        chunks.withColumn("prev_context", F.coalesce(F.right(prev, F.lit(size)), F.lit("")))
        .withColumn("next_context", F.coalesce(F.left(after, F.lit(size)), F.lit("")))
        .withColumn("has_prev", prev.isNotNull())
        .withColumn("has_next", after.isNotNull())
        .withColumn("section_type", section_label(F.col("chunk_text")))
    )
