"""A folder of files and the vectors of its articles, kept equal: what files no longer hold is removed.

The state is a home folder of tables to which each version appends: files (path, mark; null once
deleted), holdings (path, article, text: what a file held from that version on) and vectors
(article, text's digest, embedding; null once removed). A file's last version says which of
its holdings count, so a modified file replaces what it held and a deleted one holds nothing.
An article is there as long as any file holds it; of several texts that of the greatest path
counts. Versions are committed last: what a broken turn left behind is not read, and the next
turn writes the same version again.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import released, stored
from .incremental import diff, manifest, stored_or_none

#: Paths that a read is given at once.
PATHS = 10_000


def _last(df: DataFrame, key: str) -> DataFrame:
    """Each key's row of the last version."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("version").desc()))).filter("_n = 1").drop("_n")


def _table(spark: SparkSession, home: str, name: str, schema: str, version: int) -> DataFrame:
    df = stored_or_none(spark, f"{home}/{name}") if version >= 0 else None
    if df is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{home}/{name}").filter(F.col("version") <= version)


def version_of(spark: SparkSession, home: str) -> int:
    done = stored_or_none(spark, f"{home}/versions")
    return -1 if done is None else done.agg(F.max("version")).first()[0]


def files(spark: SparkSession, home: str, version: int) -> DataFrame:
    """path, mark, version of the files that are there."""
    return _last(_table(spark, home, "files", "path string, mark string, version int", version), "path").filter("mark is not null")


def holdings(spark: SparkSession, home: str, version: int) -> DataFrame:
    """path, article, text of the files that are there."""
    held = _table(spark, home, "holdings", "path string, article string, text string, version int", version)
    return held.join(files(spark, home, version).select("path", "version"), ["path", "version"]).select("path", "article", "text")


def articles(held: DataFrame) -> DataFrame:
    """article, files (how many hold it), text (of the greatest path), digest."""
    one = held.groupBy("article").agg(F.count_distinct("path").alias("files"), F.max_by("text", F.struct("path", "text")).alias("text"))
    return one.withColumn("digest", F.md5("text"))


def vectors(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    """article, digest, embedding of the articles that are there."""
    v = version_of(spark, home) if version is None else version
    path = f"{home}/vectors"
    if v < 0 or stored_or_none(spark, path) is None:
        return spark.createDataFrame([], "article string, digest string, embedding array<double>")
    return _last(spark.read.parquet(path).filter(F.col("version") <= v), "article").filter("digest is not null").drop("version")


def synchronise(spark: SparkSession, folder: str, home: str, read: Callable[[SparkSession, list[str]], DataFrame], embed: Callable[[DataFrame], DataFrame], by_content: bool = False) -> DataFrame:
    """Brings the vectors in ``home`` up to the files in ``folder``; one row of status, new, modified, deleted (files), added, changed, removed (articles).

    read: from paths to rows of path, article, text. embed: from rows of article, text to
    article, embedding. Only new and modified files are read, and only articles whose text is
    new are encoded. Rows without an article are left out. by_content: files are told by
    their contents' digest rather than by length and time.
    """
    last = version_of(spark, home)
    v = last + 1
    before = files(spark, home, last)
    changes = stored(diff(manifest(spark, folder, by_content), before.select("path", "mark")).join(manifest(spark, folder, by_content), "path", "left"), "changes")
    counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        released(changes)
        return _told(spark, "no_changes", counts, (0, 0, 0))
    to = lambda name: f"{home}/{name}"
    stamped = lambda d: d.withColumn("version", F.lit(v))
    for name in ("files", "holdings", "vectors"):
        _drop_version(spark, to(name), v)
    put = lambda d, name: d.write.mode("overwrite").parquet(f"{to(name)}/v={v}")
    put(stamped(changes.select("path", "mark")), "files")
    paths = (r["path"] for r in changes.filter("change <> 'deleted'").select("path").toLocalIterator())
    came = None
    for n, some in enumerate(iter(lambda: list(itertools.islice(paths, PATHS)), [])):
        rows = read(spark, some).filter("article is not null").select("path", "article", F.coalesce("text", F.lit("")).alias("text"))
        stamped(rows).write.mode("append").parquet(f"{to('holdings')}/v={v}")
        came = n
    old = articles(holdings(spark, home, last)).select(F.col("article").alias("_a"), F.col("digest").alias("_d"))
    new = articles(_now(spark, home, v, came is not None))
    both = stored(new.join(old, F.col("article") == F.col("_a"), "full_outer").filter("NOT (digest <=> _d)"), "articles")
    n = both.agg(F.count_if(F.col("_d").isNull()), F.count_if(F.col("digest").isNotNull() & F.col("_d").isNotNull()), F.count_if(F.col("digest").isNull())).first()
    wanted = both.filter("digest is not null")
    made = wanted.select("article", "digest").join(embed(wanted.select("article", "text")), "article", "left").select("article", "digest", F.col("embedding").cast("array<double>").alias("embedding"))
    gone = both.filter("digest is null").select(F.col("_a").alias("article"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("array<double>").alias("embedding"))
    put(stamped(made.unionByName(gone)), "vectors")
    spark.createDataFrame([(v,)], "version int").coalesce(1).write.mode("append").parquet(to("versions"))
    released(changes, both)
    return _told(spark, "updated", counts, tuple(n))


def _now(spark: SparkSession, home: str, v: int, some: bool) -> DataFrame:
    """Holdings as of a version that is being written."""
    if not some and stored_or_none(spark, f"{home}/holdings") is None:
        return spark.createDataFrame([], "path string, article string, text string")
    return holdings(spark, home, v)


def _drop_version(spark: SparkSession, path: str, v: int) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _told(spark: SparkSession, status: str, counts: dict[str, int], n: tuple) -> DataFrame:
    row = (status, *(counts.get(c, 0) for c in ("new", "modified", "deleted")), *n)
    return spark.createDataFrame([row], "status string, new bigint, modified bigint, deleted bigint, added bigint, changed bigint, removed bigint")
