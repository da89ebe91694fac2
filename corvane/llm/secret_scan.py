"""Secret scanning over an incremental blob ledger (built-in DataFrame functions only).

Every version of a file is addressed by the SHA-256 of its content (a blob). The ledger
holds the pairs of blob and rule version that have been scanned, with their findings. A scan
reads the versions, keeps one text of each blob, leaves out the rules the ledger holds for
it, scans the rest and adds it to the ledger, which is a Parquet folder; the findings of all
blobs join back from there to every path that holds them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty

# Kind, pattern, group whose length counts, least length. Letter classes stand for either case of A-Z and no other letter.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def rule_version(kind: str, pattern: str, group: int, least: int) -> str:
    """A rule's name and a digest of what it says: a changed rule is a new version, which no ledger holds yet."""
    return f"{kind}:{hashlib.sha256(f'{pattern}|{group}|{least}'.encode()).hexdigest()[:12]}"


def blobs(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per distinct content: blob (SHA-256), text. The map side keeps one text of each blob before any row moves."""
    text = text_or_empty(text_col)
    return versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def _matches(rule: tuple) -> Column:
    kind, pattern, group, least = rule
    return F.when(
        F.array_contains("todo", rule_version(*rule)),
        F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("part")) if group else F.struct((w := F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("whole"), w.alias("part")),
    ).alias(kind)


def scan(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Scans what the ledger lacks; returns the new ledger rows: blob, rule, spans (in code points, end exclusive).

    Matches are leftmost and do not overlap within a rule; one whose counted group is
    shorter than the rule's least length is dropped, and the text it covers is not searched
    again. A scanned pair without findings is a row with no spans. Null texts count as
    empty; repeated rows are one blob.
    """
    everything = F.array(*[F.lit(rule_version(*r)) for r in rules])
    todo = blobs(versions, text_col)
    if ledger is None:
        todo = todo.withColumn("todo", everything)
    else:
        seen = ledger.groupBy(F.col("blob").alias("_blob")).agg(F.collect_set("rule").alias("_seen"))
        todo = todo.join(seen, F.col("blob") == F.col("_blob"), "left").withColumn("todo", F.array_except(everything, F.coalesce("_seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0).select("blob", "text", "todo")
    found = todo.select("blob", "text", "todo", *[_matches(r) for r in rules])
    # split() gives what lies between the matches, so the running sum of both lengths is each match's place.
    each = F.filter(
        F.array(*[F.when(F.size(F.col(f"{r[0]}.whole")) > 0, F.struct(F.lit(rule_version(*r)).alias("rule"), F.lit(r[3]).alias("least"), F.col(f"{r[0]}.whole").alias("whole"), F.col(f"{r[0]}.part").alias("part"), F.split("text", r[1], -1).alias("between"))) for r in rules]),
        lambda x: x.isNotNull(),
    )
    hits = (
        found.select("blob", F.explode(each).alias("x"))
        .select("blob", "x.rule", "x.least", F.posexplode(F.arrays_zip("x.whole", "x.part", "x.between")).alias("i", "m"))
        .filter(F.col("m.whole").isNotNull())
        .select("blob", "rule", "least", "i", F.length("m.whole").alias("n"), F.length("m.part").alias("counted"), F.length("m.between").alias("before"))
    )
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("before") + F.col("n")).over(upto)).filter(F.col("counted") >= F.col("least"))
    spans = placed.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("n")).alias("start"), F.col("end")))).alias("spans"))
    return todo.select("blob", F.explode("todo").alias("rule")).join(spans, ["blob", "rule"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in a folder; none where nothing was written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(folder)


def update_ledger(versions: DataFrame, folder: str, text_col: str = "text", rules: tuple = RULES) -> None:
    """Scans the blobs of ``versions`` that the ledger in the folder lacks, by rule version, and appends them to it. A second run with the same versions and rules scans nothing."""
    scan(versions, read_ledger(versions.sparkSession, folder), text_col, rules).write.mode("append").parquet(folder)


def findings(versions: DataFrame, ledger: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Every path with the findings of its blob: ``path_col``, blob, found (structs of start, order of the rule, kind, end).

    One row per row of ``versions``; a path without findings has an empty list.
    """
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (rule_version(*r), i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (rule_version(*r), r[0])])
    known = ledger.filter(F.col("rule").isin([rule_version(*r) for r in rules]) & (F.size("spans") > 0))
    by_blob = (
        known.select("blob", number[F.col("rule")].alias("order"), kind[F.col("rule")].alias("kind"), F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), "order", "kind", F.col("s.end").alias("end")))).alias("found"))
    )
    paths = versions.select(F.col(path_col).alias("_path"), F.sha2(text_or_empty(text_col), 256).alias("blob"))
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    return paths.join(by_blob, "blob", "left").select(F.col("_path").alias(path_col), "blob", F.coalesce("found", empty).alias("found"))
