"""Exact deduplication by a content sort (built-in DataFrame functions only).

Texts are normalised by lower-casing A-Z. Spark samples splitters and range-partitions all
rows by the normalised text (its beginning, then a digest where beginnings are equal, so that
a sample's size does not depend on the texts' lengths; beyond SPLITTER characters the order is
the digest's). Each partition is sorted, spilling to disk as needed, which puts equal texts side by side;
the window over the sorted run compares each whole text with its neighbour and keeps one
identifier of every run.

A text so frequent that its run would overload one range is told beforehand by a map-side
combined count. It is sorted like any other, but in several runs, dealt by a hash of the
identifier; the few results of its runs are then merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, partitions, rows_as_struct, text_or_empty

#: A run has at most one part in HOT_SHARE of a mean partition's rows, or is dealt in parts of that size: fewer than HOT_SHARE * partitions texts are.
HOT_SHARE = 4
#: Characters of a text that the range partitioning looks at, before a digest of the whole.
SPLITTER = 64


def _marked(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with _keep, _size, _sha and _rn (place among those that a whole run holds): of texts in one run, and of texts in several."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.max if keep == "largest" else F.min
    first = (lambda c: c.desc_nulls_last()) if keep == "largest" else (lambda c: c.asc_nulls_last())
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *([rows_as_struct(docs)] if carry else []))
    extra = ["_row"] if carry else []

    # Texts that are equal under ascii_lower are equal under lower(), which costs less: this only decides in how many runs a text is sorted.
    weak = F.xxhash64(F.lower("_text"))
    limit = max(1, docs.count() // (HOT_SHARE * partitions(docs.sparkSession)))
    hot = cut(base.groupBy(weak.alias("_weak")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("_weak", F.ceil(F.col("_n") / limit).alias("_runs")))

    dealt = base.withColumn("_w", weak).join(F.broadcast(hot), F.col("_w") == F.col("_weak"), "left")
    part = F.when(F.col("_runs").isNotNull(), F.pmod(F.xxhash64("_id"), "_runs")).otherwise(F.lit(-1))
    placed = dealt.select("_id", part.alias("_part"), ascii_lower(F.col("_text")).alias("_norm"), *extra).withColumn("_head", F.substring("_norm", 1, SPLITTER)).withColumn("_tie", F.xxhash64("_norm"))
    ranged = placed.repartitionByRange("_head", "_tie", "_part")
    run = Window.partitionBy("_head", "_tie", "_part", "_norm").orderBy(first(F.col("_id")))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ranged.select("_id", "_part", F.first("_id").over(whole).alias("_keep"), F.count(F.lit(1)).over(whole).alias("_size"), F.row_number().over(run).alias("_rn"), F.sha2("_norm", 256).alias("_sha"), *extra)

    single = rows.filter("_part < 0")
    several = rows.filter("_part >= 0")
    # One row a run: fewer than 2 * HOT_SHARE * partitions.
    totals = several.filter("_rn = 1").groupBy(F.col("_sha").alias("_s")).agg(best("_keep").alias("_best"), F.sum("_size").alias("_all"))
    merged = several.drop("_size").join(F.broadcast(totals), F.col("_sha") == F.col("_s")).withColumn("_rn", F.when(F.col("_keep").eqNullSafe(F.col("_best")), F.col("_rn")).otherwise(F.lit(0)))
    return single, merged.select("_id", F.col("_best").alias("_keep"), F.col("_all").alias("_size"), "_rn", "_sha", *extra)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts are equal. A null id is kept only if its
    group holds no other. A row repeated with the same id and text is one document: its
    repeats count in group_size and carry the same flag. An empty table gives an empty
    result. Other columns are not read, whatever their names.
    """
    columns = ["_id", "_keep", "_size", "_sha"]
    single, several = _marked(docs, id_col, text_col, keep, carry=False)
    both = single.select(columns).unionByName(several.select(columns))
    return both.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of a row repeated whole, one stays."""
    single, several = _marked(docs, id_col, text_col, keep, carry=True)
    # Rows with the kept id are in one run: all rows of an id are dealt to the same.
    return single.filter("_rn = 1").select("_row").unionByName(several.filter("_rn = 1").select("_row")).select("_row.*")
