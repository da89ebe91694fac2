"""Retrieval evaluation: hits (query_id, doc_id, rank) against judgments (query_id, doc_id, grade), or classes that stand for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Classes:
    """Judgments that are never written as pairs: each query (query_id, class; one class a query) against every document of its class (doc_id, class, grade) but its own."""

    queries: DataFrame
    documents: DataFrame


def _of_pairs(hits: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """query_id of all judged queries; query_id, grade, n: relevant documents by grade; and the hits that are relevant, with their grade."""
    relevant = judged.filter("grade > 0").groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    counts = relevant.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    return judged.select("query_id").distinct(), counts, hits.join(relevant, ["query_id", "doc_id"])


def _of_classes(hits: DataFrame, judged: Classes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from counts of classes and grades: a query's own document is taken off its class's."""
    asked = judged.queries.filter("class is not null").distinct()
    members = judged.documents.filter("class is not null").groupBy("doc_id", "class").agg(F.max("grade").alias("grade"))
    own = asked.join(members.withColumnRenamed("doc_id", "query_id"), ["query_id", "class"]).select("query_id", "grade", F.lit(1).alias("own"))
    by_grade = asked.join(members.groupBy("class", "grade").agg(F.count(F.lit(1)).alias("n")), "class")
    counts = by_grade.join(own, (by_grade["query_id"] == own["query_id"]) & by_grade["grade"].eqNullSafe(own["grade"]), "left")
    counts = counts.select(by_grade["query_id"], by_grade["grade"], (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).filter("n > 0")
    found = hits.join(asked, "query_id").join(members.filter("grade > 0"), ["doc_id", "class"]).filter("query_id <> doc_id").drop("class")
    return counts.select("query_id").distinct(), counts.filter("grade > 0"), found


def collapse(hits: DataFrame, sep: str = "_") -> DataFrame:
    """Chunk hits (doc_id as key_no) as document hits: the first of each document, ranked anew."""
    named = hits.withColumn("doc_id", F.split_part(F.col("doc_id").cast("string"), F.lit(sep), F.lit(1)))
    first = named.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def per_query(hits: DataFrame, judged: DataFrame | Classes, ks: tuple[int, ...] = (5, 10), normalize: str = "retrieved") -> DataFrame:
    """query_id with p_k, r_k, ndcg_k for every k, rr, ap and hit. Every judged query has a row, with zeros if nothing was retrieved.

    Average precision divides by the relevant hits retrieved, or by all relevant documents
    with normalize="relevant". Gains are 2^grade - 1, discounted by log2(rank + 1).
    """
    asked, counts, found = (_of_classes if isinstance(judged, Classes) else _of_pairs)(hits, judged)
    # Of the ideal order only the first places count; n is told in the row of each grade's first.
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("grade").desc())))
    first = F.col("upto") - F.col("n") + 1
    places = F.sequence(first, F.greatest(first, F.least("upto", F.lit(max(ks)))))
    ideal = upto.select("query_id", "grade", "n", first.alias("first"), F.explode(places).alias("i"))
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(rank) + 1)
    totals = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("i") == F.col("first"), F.col("n"))).alias("n"), *[F.sum(F.when(F.col("i") <= k, gain("i")).otherwise(0.0)).alias(f"idcg_{k}") for k in ks])
    running = found.withColumn("so_far", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    got = running.groupBy("query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"h_{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, gain("rank")).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
        F.max(1 / F.col("rank")).alias("rr"),
        F.sum(F.col("so_far") / F.col("rank")).alias("ap"),
        F.count(F.lit(1)).alias("found"),
    )
    joined = asked.join(totals, "query_id", "left").join(got, "query_id", "left").na.fill(0)
    share = F.when(F.col("found") > 0, F.col("ap") / (F.col("found") if normalize == "retrieved" else F.col("n"))).otherwise(F.lit(0.0))
    zero = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return joined.select(
        "query_id",
        *[x for k in ks for x in ((F.col(f"h_{k}") / k).alias(f"p_{k}"), zero(f"h_{k}", "n").alias(f"r_{k}"), zero(f"dcg_{k}", f"idcg_{k}").alias(f"ndcg_{k}"))],
        F.col("rr").alias("rr"),
        share.alias("ap"),
        (F.col("found") > 0).cast("double").alias("hit"),
    )


def summary(scores: DataFrame, method: str, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """method, metric, mean, std of the metrics (population deviation, four places), and f1_k of the rounded means."""
    names = [c for c in scores.columns if c != "query_id"]
    wide = scores.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = wide.select(*[F.round(c, 4).alias(c) for c in wide.columns])
    f1 = lambda k: F.when(F.col(f"m_p_{k}") + F.col(f"m_r_{k}") > 0, F.round(2 * F.col(f"m_p_{k}") * F.col(f"m_r_{k}") / (F.col(f"m_p_{k}") + F.col(f"m_r_{k}")), 4)).otherwise(F.lit(0.0))
    row = lambda metric, mean, std: F.struct(F.lit(metric).alias("metric"), mean.alias("mean"), std.cast("double").alias("std"))
    rows = F.array(*[row(c, F.col(f"m_{c}"), F.col(f"s_{c}")) for c in names], *[row(f"f1_{k}", f1(k), F.lit(None)) for k in ks])
    return wide.select(F.lit(method).alias("method"), F.explode(rows).alias("x")).select("method", "x.*")


def compare(summaries: list[DataFrame], methods: list[str]) -> DataFrame:
    """metric with a column of means for each method."""
    both = summaries[0]
    for s in summaries[1:]:
        both = both.unionByName(s)
    return both.groupBy("metric").pivot("method", methods).agg(F.first("mean"))


def judged_from_topics(docs: DataFrame, key: str = "doc_id", topic: str = "topic", title: str = "title", per_topic: int = 3, relevant: int = 10, least_docs: int = 10, least_title: int = 20, grade: int = 2) -> DataFrame:
    """query_id, query, relevant_doc_ids, grade: titles of topics with enough documents stand for questions, the topic's first documents for answers."""
    large = docs.groupBy(F.col(topic).alias("_t")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_docs)
    big = docs.join(large.select("_t"), F.col(topic) == F.col("_t"), "left_semi")
    # At most ``relevant`` ids per topic are gathered.
    first = big.withColumn("_i", F.row_number().over(Window.partitionBy(topic).orderBy(key))).filter(F.col("_i") <= relevant)
    ids = first.groupBy(topic).agg(F.array_sort(F.collect_list(key)).alias("relevant_doc_ids"))
    order = Window.partitionBy(topic).orderBy(F.md5(F.col(key).cast("string")), key)
    asked = big.filter(F.length(title) >= least_title).withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= per_topic)
    return asked.join(ids, topic).select(F.concat_ws("_", topic, key).alias("query_id"), F.col(title).alias("query"), "relevant_doc_ids", F.lit(grade).alias("grade"))


def below(summary_rows: DataFrame, metric: str, least: float) -> DataFrame:
    """Methods that fail a gate."""
    return summary_rows.filter((F.col("metric") == metric) & (F.col("mean") < least))


def ablation(queries: DataFrame, judged: DataFrame | Classes, settings: dict, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Summaries of the same queries under named retrieval settings: name -> function from queries to hits."""
    out = None
    for name, retriever in settings.items():
        part = summary(per_query(retriever(queries), judged, ks), name, ks)
        out = part if out is None else out.unionByName(part)
    return out
