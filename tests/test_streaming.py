"""Counters of many batches, and a store whose keys come again."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.sources.tables import new_folder
from corvane.streaming import stages


def test_counters_of_more_batches_than_spark_remembers(spark):
    out = new_folder(spark, "batches")
    spark.range(1500).repartition(150).write.parquet(f"{out}/in")
    stream = stages.counted(stages.read_files(spark, f"{out}/in", "id bigint", most=1), "counters", F.col("id") % 10 == 0, F.col("id"))
    with stages.counter_log(spark, f"{out}/counters", "counters"):
        run = stages.each_batch(stream, lambda b, n: b.write.format("noop").mode("overwrite").save(), f"{out}/offsets")
        run.awaitTermination()
    assert len(run.recentProgress) <= 100
    rows = stages.read_counters(spark, f"{out}/counters").agg(F.count(F.lit(1)), F.sum("consumed"), F.sum("failed"), F.sum("bytes")).first()
    assert tuple(rows) == (150, 1500, 150, sum(range(1500)))


def test_last_versions_across_batches_and_compactions(spark):
    store = new_folder(spark, "store")
    work = stages.upserted_batches(lambda d: d, store)
    put = lambda n, rows: work(spark.createDataFrame(rows, "chunk_id string, seq int, v string"), n)
    got = lambda: {r.chunk_id: (r.seq, r.v) for r in stages.latest(spark, store).collect()}
    put(0, [("a", 1, "a1"), ("b", 1, "b1"), ("b", 2, "b2"), (None, 1, "x")])
    put(0, [("a", 1, "a1"), ("b", 1, "b1"), ("b", 2, "b2")])
    assert got() == {"a": (1, "a1"), "b": (2, "b2")}
    put(1, [("a", 1, "again"), ("b", 1, "late"), ("c", 5, "c5")])
    assert got() == {"a": (1, "again"), "b": (2, "b2"), "c": (5, "c5")}
    stages.compact(spark, store)
    assert got() == {"a": (1, "again"), "b": (2, "b2"), "c": (5, "c5")}
    put(2, [("c", 4, "late"), ("d", 1, None), ("b", 3, "b3")])
    stages.compact(spark, store)
    put(3, [("d", 2, "d2")])
    assert got() == {"a": (1, "again"), "b": (3, "b3"), "c": (5, "c5"), "d": (2, "d2")}
    assert {r.batch for r in spark.read.parquet(store).filter(F.col("batch") > stages._bases(spark, store)[0]).collect()} == {3}
