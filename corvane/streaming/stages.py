"""Structured Streaming: article, chunk and vector stages with checkpoints."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.chunk import explode_chunks, sliding
from ..sources.tables import MESSAGE


def read_topic(spark: SparkSession, servers: str, topic: str, schema: str = MESSAGE, most: int = 1000) -> DataFrame:
    """A Kafka topic of JSON values keyed by id, as columns."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", most).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", most: int = 100) -> DataFrame:
    """A folder in which files arrive, with the same columns as the topic."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", most).load(path)


def as_messages(df: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows as key and JSON value, for a topic sink."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def chunked(articles: DataFrame, key: str = "pmid", text: str = "text") -> DataFrame:
    """Stage 1: sliding chunks, numbered over those kept."""
    return explode_chunks(articles, key, sliding(F.col(text)))


def write(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    w = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """A caller's function on every micro-batch; offsets are committed after it returns, so a failed batch comes again."""
    w = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def encoded_batches(embed: Callable[[DataFrame], DataFrame], store: str, key: str = "chunk_id") -> Callable[[DataFrame, int], None]:
    """Stage 2: encodes a batch's chunks and writes them under its number, so that a repeated batch replaces itself."""

    def work(batch: DataFrame, number: int) -> None:
        embed(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return work


def counted(df: DataFrame, name: str, failed, size) -> DataFrame:
    """The stream with counters of consumed and failed rows and of bytes, reported with every batch."""
    return df.observe(name, F.count(F.lit(1)).alias("consumed"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counters by event time, with a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"))


class CounterLog(StreamingQueryListener):
    """Writes what a stream's batches report under a name (see ``counted``): a file a batch, named by query and batch, so that one reported again replaces itself."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self.spark, self.folder, self.name = spark, folder, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name not in p.observedMetrics:
            return
        row = {"query": str(p.id), "batch": p.batchId, **p.observedMetrics[self.name].asDict()}
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.id}-{p.batchId}.json")
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()


@contextlib.contextmanager
def counter_log(spark: SparkSession, folder: str, name: str) -> Iterator[None]:
    """While it is open, counters of all batches go to the folder; it closes once those of ended batches are written."""
    log = CounterLog(spark, folder, name)
    spark.streams.addListener(log)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        spark.streams.removeListener(log)


def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    """query, batch, consumed, failed, bytes of every batch in a log."""
    return spark.read.schema("query string, batch bigint, consumed bigint, failed bigint, bytes bigint").json(folder)


def upserted_batches(embed: Callable[[DataFrame], DataFrame], store: str, key: str = "chunk_id", order: str = "seq") -> Callable[[DataFrame, int], None]:
    """Stage 2 with versions: of each key of a batch the row of greatest ``order`` is encoded and written under the batch's number, so that a repeated batch replaces itself. Read by ``latest``."""

    def work(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c not in (key, order)]
        one = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *columns)).alias("_r")).select(key, "_r.*")
        embed(one).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return work


def _bases(spark: SparkSession, store: str) -> tuple[int, str | None]:
    """The last batch that is compacted, and where."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}-bases")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return -1, None
    row = spark.read.schema("upto bigint, path string").json(f"{store}-bases").orderBy(F.col("upto").desc()).first()
    return row["upto"], row["path"]


def latest(spark: SparkSession, store: str, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """Each key's row of greatest ``order`` (of equals that of the last batch), from the last compacted table and the batches after it."""
    upto, base = _bases(spark, store)
    rows = spark.read.parquet(store).filter(F.col("batch") > upto)
    if base is not None:
        rows = rows.unionByName(spark.read.parquet(base).withColumn("batch", F.lit(-1)))
    w = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("batch").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "batch")


def compact(spark: SparkSession, store: str, key: str = "chunk_id", order: str = "seq") -> None:
    """Writes ``latest`` as one table that later reads begin with; the table is named once it is whole."""
    upto = spark.read.parquet(store).agg(F.max("batch")).first()[0]
    path = f"{store}-base-{upto}"
    latest(spark, store, key, order).write.mode("overwrite").parquet(path)
    spark.createDataFrame([(upto, path)], "upto bigint, path string").coalesce(1).write.mode("append").json(f"{store}-bases")
