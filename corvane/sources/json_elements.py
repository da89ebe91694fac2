"""JSON arrays of any size, on one line or on many, read by as many tasks as the files have blocks.

Spark's text source cuts a file at every "}" and deals it out in byte ranges; ``_metadata``
says which range a piece comes from. A range does not know whether it begins inside a string,
nor how deep, so there are two passes:

1. Every range tells how it changes both, once for each of the two ways it may begin. These
   summaries (a row a range) are added up along each file.
2. Every range, now knowing where it begins, puts its pieces together to elements. Those that
   cross its edges come as fragments, at most two a range, and only these are shuffled.

Inside a string a "}" is never escaped, so no escape crosses two pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut

#: Ranges whose states are broadcast (some 150 bytes each); beyond that pieces and states are shuffled by range.
BROADCAST = 200_000
_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _depths(piece: str) -> tuple[int, int, bool]:
    """How much deeper a piece leads if it begins outside of a string or inside one, and whether it ends on the other side of a quote."""
    parts = _ESCAPED.sub("", piece).split('"')
    outside, inside = "".join(parts[0::2]), "".join(parts[1::2])
    delta = lambda s: s.count("{") + s.count("[") - s.count("]")
    return delta(outside), delta(inside), len(parts) % 2 == 0


def _after(inside: bool, depth: int, piece: str) -> tuple[bool, int]:
    """Where the file stands behind a piece and the "}" that ended it."""
    outer, inner, turned = _depths(piece)
    now = inside != turned
    return now, depth + (inner if inside else outer) - (not now)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of one range's pieces in a batch; ``no`` is its place among them."""
    no = 0
    for batch in batches:
        rows: list[list] = []
        for path, block, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not rows or rows[-1][:2] != [path, block]:
                rows.append([path, block, no, 0, 0, False])
                no += 1
            row = rows[-1]
            row[3], row[4] = (_after(begins != row[5], depth, piece)[1] for begins, depth in ((False, row[3]), (True, row[4])))
            row[5] ^= _depths(piece)[2]
        names = ["path", "block", "no", "outer", "inner", "turned"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=names)


def _states(pieces: DataFrame) -> DataFrame:
    """path, block, inside, depth: where every range begins."""
    before = Window.partitionBy("path").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, -1)
    runs = pieces.mapInArrow(_summaries, "path string, block bigint, no bigint, outer bigint, inner bigint, turned boolean")
    begins = runs.withColumn("inside", F.coalesce(F.sum(F.col("turned").cast("int")).over(before) % 2 == 1, F.lit(False)))
    delta = F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))
    deep = begins.withColumn("depth", F.coalesce(F.sum(delta).over(before), F.lit(0)))
    return deep.groupBy("path", "block").agg(F.min_by("inside", "no").alias("inside"), F.min_by("depth", "no").alias("depth"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, block, part, done, text. part: 0 up to the first end of an element in a range, 1 for what is left at its end, null for whole elements between."""
    at, inside, depth, held, first = None, False, 0, [], True
    names, kinds = ["path", "block", "part", "done", "text"], (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
    for batch in batches:
        rows = []
        for path, block, piece, begins, level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (path, block):
                if held:
                    rows.append((*at, 0 if first else 1, False, "".join(held)))
                at, inside, depth, held, first = (path, block), begins, level, [], True
            inside, depth = _after(inside, depth, piece)
            held.append(piece + "}")
            if not inside and depth == 1:
                rows.append((path, block, 0 if first else None, True, "".join(held)))
                held, first = [], False
        yield made(rows)
    if held:
        yield made([(*at, 0 if first else 1, False, "".join(held))])


def elements(spark: SparkSession, path: str, broadcast: int = BROADCAST) -> DataFrame:
    """value: the JSON text of every object that is an element of an array in the files.

    Files are read three times and not kept. An element that is no object is passed over, one
    that its file never ends is dropped; an empty file or array gives no rows. Elements of an
    array may have any depth and cross any number of ranges; one element has to fit a task.
    """
    pieces = _pieces(spark, path)
    states = cut(_states(pieces))
    on = ["path", "block"]
    if states.count() <= broadcast:
        known = pieces.join(F.broadcast(states), on)
    else:
        known = pieces.withColumn("_at", F.monotonically_increasing_id()).join(states.hint("merge"), on).repartition(*on).sortWithinPartitions(*on, "_at").drop("_at")
    found = known.select("path", "block", "value", "inside", "depth").mapInArrow(_elements, "path string, block bigint, part int, done boolean, text string")
    edges = found.filter("part is not null")
    upto = Window.partitionBy("path").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("n", F.coalesce(F.sum(F.col("done").cast("bigint")).over(upto), F.lit(0)))
    joined = edges.groupBy("path", "n").agg(F.max("done").alias("done"), F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("parts"))
    crossing = joined.filter("done").select(F.array_join(F.col("parts.text"), "").alias("text"))
    return found.filter("part is null").select("text").unionByName(crossing).select(F.expr("substring(text, instr(text, '{'))").alias("value"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the arrays' elements; what does not fit the schema is null, as in Spark's own reader."""
    return elements(spark, path).select(F.from_json("value", schema).alias("x")).select("x.*")
