"""Parquet and JSON tables: scans with declared schemas, sinks, and lineage cuts in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE = "pmid string, title string, abstract string, authors array<string>, pub_date string, keywords array<string>, mesh_terms array<string>, topic string, full_text string"
JUDGED = "id string, query string, relevant_doc_ids array<string>, relevance_grades array<int>, answer string, source string"
CHUNK = "id string, pmid string, chunk_id string, chunk_text string, title string, topic string, content string"
MESSAGE = "pmid string, title string, abstract string, topic string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset in a local session (as in tests), one is made and set once a session;
    on a cluster that is an error, since no folder of one machine would do.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
    return named or sc._jsc.sc().getCheckpointDir().get().rsplit("/", 1)[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage is cut, and the planner knows the size. Shuffle files of the write go with it."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def freed(spark: SparkSession) -> None:
    """Collects the driver's garbage: Spark then removes the shuffle files of what nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._folder)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with _place (its number in an order, from 0) and the sums of expressions over the rows before, as columns of the given names.

    Rows are range-partitioned and sorted; places and sums are taken within partitions and
    set off by the partitions' totals, so that no window holds all rows.
    """
    sums = {"_place": F.lit(1)} | (sums or {})
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumns({f"{n}+": e.cast("bigint") for n, e in sums.items()}).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "running")
    upto = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy(F.col("_part").alias("_p")).agg(*[F.sum(f"{n}+").alias(n) for n in sums])
    parts = parts.select("_p", *[upto(n, Window.orderBy("_p")).alias(f"{n}<") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_at")
    within = ranged.select("*", *[upto(f"{n}+", inside).alias(f"{n}-") for n in sums])
    return within.join(F.broadcast(parts), F.col("_part") == F.col("_p")).select(*df.columns, *[(F.col(f"{n}-") + F.col(f"{n}<")).alias(n) for n in sums])


def read_articles(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Articles of a JSON array on one line or of JSON lines; multi_line for a pretty-printed array."""
    return spark.read.schema(ARTICLE).option("multiLine", multi_line).json(path)


def read_topic_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Articles of files named checkpoint_<topic>.data.json; an article without a topic takes its file's."""
    df = spark.read.schema(ARTICLE).json(pattern)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    of_file = F.regexp_extract(name, r"checkpoint_(.*)\.data\.json", 1)
    return df.withColumn("topic", F.coalesce("topic", of_file))


def write_topic_files(df: DataFrame, path: str, topic: str = "topic") -> None:
    """One JSON-lines file named checkpoint_<topic>.data.json for every topic; rows without a topic go to none."""
    spark = df.sparkSession
    parts = f"{path}/_parts"
    df.filter(F.col(topic).isNotNull()).withColumn("_t", F.col(topic)).repartition("_t").write.partitionBy("_t").json(parts)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # One renaming a topic; contents are not read.
    for folder in fs.listStatus(at(parts)):
        if folder.isDirectory():
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder.getPath().getName().partition("=")[2])
            for i, f in enumerate(f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")):
                fs.rename(f.getPath(), at(f"{path}/checkpoint_{name}.data.json" if i == 0 else f"{path}/{i}_checkpoint_{name}.data.json"))
    fs.delete(at(parts), True)


def read_judged(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    df = spark.read.schema(JUDGED).option("multiLine", True).json(path)
    return df if n is None else df.orderBy("id").limit(n)


def judgments(judged: DataFrame) -> DataFrame:
    """query_id, doc_id, grade: one row per relevant document."""
    return judged.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("relevant_doc_ids", "relevance_grades")).alias("x")).select("query_id", F.col("x.relevant_doc_ids").alias("doc_id"), F.coalesce("x.relevance_grades", F.lit(1)).alias("grade"))


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_sample(df: DataFrame, path: str, order: str, n: int = 1000) -> None:
    df.orderBy(order).limit(n).write.mode("overwrite").json(path)


def list_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """name, size_mb, last_modified of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(name.startswith(prefix)).select(name.alias("name"), F.round(F.col("length") / (1024 * 1024), 4).alias("size_mb"), F.col("modificationTime").alias("last_modified"))


def append_stamped(df: DataFrame, path: str, now: Column) -> None:
    """Appends rows with created_at and updated_at; the time is given, so a rerun is the same."""
    df.withColumn("created_at", now).withColumn("updated_at", now).write.mode("append").parquet(path)


def query_log(df: DataFrame) -> DataFrame:
    """Log rows of (timestamp, query, metrics, ids): the number of results and the first ten ids."""
    return df.select("timestamp", "query", F.size("ids").alias("num_results"), "metrics", F.slice("ids", 1, 10).alias("result_ids"))


def vector_rows(df: DataFrame, limit: int = 2000) -> DataFrame:
    """Rows for a vector store: texts cut to what it takes."""
    return df.withColumn("chunk_text", F.substring("chunk_text", 1, limit))


def attach_vectors(meta: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """By chunk id, never by position."""
    return meta.join(vectors, key)


def append_evaluation(rows: DataFrame, path: str, model: str, when: Column) -> None:
    """Appends the rows of an evaluation summary with the model's name and the time, which is given, so a rerun is the same."""
    rows.withColumn("model", F.lit(model)).withColumn("evaluated_at", when).write.mode("append").parquet(path)


def supplement(wanted: DataFrame, held: DataFrame, key: str = "pmid") -> DataFrame:
    """What is wanted and not held yet."""
    return wanted.join(held.select(key).distinct(), key, "left_anti")
