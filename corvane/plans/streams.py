"""Streaming queries over files, run to their end: the same rows as their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors
from ..sources.tables import new_folder
from ..streaming import stages
from .corpus import ROWS, SLIDING
from .tables import query, table


def _files(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's file, or folder of files, as a stream. A single file is told from its neighbours by its name."""
    batch = table(spark, sf, name)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
    folder = len(batch.inputFiles()) > 1 or not batch.inputFiles()[0].endswith(f"/{name}.parquet")
    if folder:
        return stages.read_files(spark, f"{sf}/{name}.parquet", schema)
    return spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", f"{name}.parquet").load(sf)


@query(f"WITH {SLIDING}, {ROWS} SELECT doc_id || '_' || chunk_no AS chunk_id, length(c)::INT AS n FROM c")
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "stream-chunks")
    stages.write(stages.chunked(_files(spark, sf, "documents"), "doc_id"), f"{out}/data", f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("chunk_id", F.length("chunk_text").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "stream-counters")

    def work(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    stages.each_batch(_files(spark, sf, "events"), work, f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/data").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT CASE WHEN row_number() OVER (ORDER BY h) > 0 THEN h END AS hour, event_type, n FROM (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by event time; an hour is given out once the watermark has passed it."""
    out = new_folder(spark, "stream-hourly")
    counts = stages.windowed_counts(_files(spark, sf, "events"), "ts", ["event_type"])
    stages.write(counts, f"{out}/data", f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/data").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(f"WITH {SLIDING}, {ROWS} SELECT count(*) AS chunks, count(DISTINCT doc_id || '_' || chunk_no) AS ids FROM c")
def stream_vectors(spark: SparkSession, sf: str) -> DataFrame:
    out = new_folder(spark, "stream-vectors")
    chunks = stages.chunked(_files(spark, sf, "documents"), "doc_id")
    work = stages.encoded_batches(lambda b: vectors.hashed_terms(b, "chunk_id", "chunk_text"), f"{out}/data")
    stages.each_batch(chunks, work, f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("chunk_id").alias("ids"))
