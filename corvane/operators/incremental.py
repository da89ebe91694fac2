"""Keeping a corpus and its stores up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..sources.tables import cut
from .anglejoin import nearest_within

# Least similarity for reuse, seconds an answer lives, answers a store holds.
SIMILAR, TTL, CAPACITY = 0.92, 7200, 10_000


def manifest(spark: SparkSession, path: str, by_content: bool = True) -> DataFrame:
    """path, mark of the files under a folder: MD5 of the content, or of length and time for big files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    mark = F.md5("content") if by_content else F.md5(F.concat_ws("_", "length", F.col("modificationTime").cast("string")))
    return files.select("path", mark.alias("mark"))


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, change: new, modified or deleted."""
    a, b = now.select("path", F.col("mark").alias("m")), before.select("path", F.col("mark").alias("o"))
    return a.join(b, "path", "full_outer").select("path", F.when(F.col("o").isNull(), "new").when(F.col("m").isNull(), "deleted").when(F.col("m") != F.col("o"), "modified").alias("change")).filter("change is not null")


def unprocessed(df: DataFrame, done: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows whose key is not among the processed ones; a null key is never processed."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def trim_log(done: DataFrame, order: str, limit: int = 1_000_000, keep: int = 500_000) -> DataFrame:
    """The log, or its newest ``keep`` ids once it holds more than ``limit``. Ids trimmed will be processed again."""
    if done.count() <= limit:
        return done
    return done.orderBy(F.col(order).desc()).limit(keep)


def run(df: DataFrame, done_path: str, store_path: str, embed: Callable[[DataFrame], DataFrame], key: str = "pmid") -> None:
    """Encodes what is not processed: title and abstract; vectors are written first, then the ids.

    A failure in between repeats rows, whose vectors have the same key: read the store by ``latest_vectors``.
    """
    spark = df.sparkSession
    done = stored_or_none(spark, done_path)
    if done is None:
        done = df.select(key).filter("false")
    fresh = unprocessed(df, done, key).dropDuplicates([key]).withColumn("text", F.concat_ws(" ", "title", "abstract"))
    embed(fresh).write.mode("append").parquet(store_path)
    fresh.select(key).write.mode("append").parquet(done_path)


def check_and_update(spark: SparkSession, folder: str, manifest_path: str, done_path: str, store_path: str, embed: Callable[[DataFrame], DataFrame], read: Callable[[SparkSession, list[str]], DataFrame], key: str = "pmid") -> DataFrame:
    """Looks at a folder and brings the vectors up to date: one row of status, new, modified, deleted (files) and added (rows encoded).

    New and modified files are read and run through ``run``, which leaves out what was
    processed before; then the new manifest is written, so that a run that failed in between
    starts again from the old one. Deleted files are counted; their vectors stay, as other
    files may hold the same articles. Rows: status is no_changes or updated.
    """
    now = cut(manifest(spark, folder))
    versions = stored_or_none(spark, manifest_path)
    before = now.filter("false") if versions is None else versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0]).select("path", "mark")
    changes = cut(diff(now, before))
    counts = changes.groupBy().agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "modified", "deleted")])
    # File names of the changed files: they are what the next read is given.
    changed = [r["path"] for r in changes.filter("change <> 'deleted'").select("path").collect()]
    held = lambda: 0 if (d := stored_or_none(spark, done_path)) is None else d.count()
    old = held()
    if changed:
        run(read(spark, changed), done_path, store_path, embed, key)
    last = -1 if versions is None else versions.agg(F.max("version")).first()[0]
    if not changes.isEmpty():
        now.withColumn("version", F.lit(last + 1)).write.mode("append").parquet(manifest_path)
    status = F.when(F.col("new") + F.col("modified") + F.col("deleted") > 0, "updated").otherwise("no_changes")
    return counts.select(status.alias("status"), "new", "modified", "deleted", F.lit(held() - old).cast("bigint").alias("added"))


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table in a folder, or none where nothing was written yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def latest_vectors(store: DataFrame, key: str = "pmid") -> DataFrame:
    return store.dropDuplicates([key])


def remove(store: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return store.join(gone.select(key), key, "left_anti")


def semantic_reuse(questions: DataFrame, stored: DataFrame, now: Column, similar: float = SIMILAR, ttl: int = TTL, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every question with the nearest stored one (cached_id, similarity) that is alive and near enough, else nulls. stored has ts."""
    alive = stored.filter(F.col("ts") + F.make_interval(secs=F.lit(ttl)) > now)
    near, _ = nearest_within(questions, alive, similar, key, vector)
    return questions.select(F.col(key).alias("query_id")).join(near.select("query_id", F.col("doc_id").alias("cached_id"), F.col("score").alias("similarity")), "query_id", "left")


def capped(store: DataFrame, ts: str, tie: str, limit: int = CAPACITY) -> DataFrame:
    """The newest ``limit`` entries."""
    return store.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(limit)


def alive(store: DataFrame, now: Column, ttl: int = TTL, ts: str = "ts") -> DataFrame:
    return store.filter(F.col(ts) + F.make_interval(secs=F.lit(ttl)) > now)


def answer_batch(questions: DataFrame, reuse: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Questions (query_id, query) answered from the store or retrieved: (query_id, from_store, hits), and one row of totals."""
    hit = reuse.filter("cached_id is not null").select("query_id", F.lit(True).alias("from_store"))
    rest = questions.join(hit, "query_id", "left_anti")
    found = retrieve(rest).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    both = questions.select("query_id").join(hit, "query_id", "left").join(found, "query_id", "left").select("query_id", F.coalesce("from_store", F.lit(False)).alias("from_store"), F.coalesce("hits", F.lit(0)).alias("hits"))
    done = F.col("from_store") | (F.col("hits") > 0)
    return both, both.agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("success"), F.count_if(~done).alias("failed"), F.count_if("from_store").alias("from_store"))


def pair_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", F.round(cosine(F.col(a), F.col(b)), 6))

