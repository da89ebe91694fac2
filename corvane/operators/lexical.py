"""BM25 over posting tables, and the overlap score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import stored

# The Okapi constants, and the share of the mean idf that stands in for a negative one.
K1, B, FLOOR = 1.5, 0.75, 0.25


@dataclass
class Index:
    """postings: doc_id, term, tf, dl (tokens of the document); doc_len: doc_id, dl of all documents; term_df: term, df; totals: one row of n and avgdl."""

    postings: DataFrame
    doc_len: DataFrame
    term_df: DataFrame
    totals: DataFrame


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Tokens are made once and the postings kept in the shared folder, where everything else is read from."""
    split = docs.select(F.col(key).alias("doc_id"), tokens(F.coalesce(text, F.lit(""))).alias("t"))
    terms = split.select("doc_id", F.size("t").cast("bigint").alias("dl"), F.explode("t").alias("term"))
    postings = stored(terms.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", "tf", "dl"), "postings")
    held = postings.groupBy(F.col("doc_id").alias("_id")).agg(F.max("dl").alias("dl"))
    doc_len = docs.select(F.col(key).alias("doc_id")).join(held, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    totals = n.crossJoin(postings.agg(F.sum("tf").alias("_all"))).select("n", (F.coalesce("_all", F.lit(0)) / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"))
    return Index(postings, doc_len, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)


def bm25(index: Index, queries: DataFrame, k: int, key: str = "query_id", text: str = "query", k1: float = K1, b: float = B, floor: float = FLOOR, digits: int = 6) -> DataFrame:
    """query_id, doc_id, rank, score: the k best documents of positive score for every query; ties to the smaller id.

    A term said twice in a query counts twice. Postings meet the query terms by a join on
    the term, so the work grows with the postings of the terms asked for. The terms asked
    for are broadcast where Spark knows them to be few; else the join is a shuffle.
    """
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # One row for the corpus, and one for each term asked for.
    weights = index.term_df.crossJoin(F.broadcast(index.totals)).select("term", idf.alias("raw"), "avgdl")
    asked = queries.select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    weighed = asked.join(weights, "term").crossJoin(F.broadcast(weights.agg(F.avg("raw").alias("mean"))))
    weighed = stored(weighed.select("query_id", "term", "qf", "avgdl", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf")), "asked")
    matched = index.postings.join(weighed, "term")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = matched.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), digits).alias("score")).filter("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", "rank", "score")


def overlap(query: Column, text: Column) -> Column:
    """Query tokens found in the text over its length plus one, times the query's length."""
    q, d = tokens(query), tokens(text)
    return F.size(F.filter(q, lambda t: F.array_contains(d, t))) / (F.size(d) + 1) * F.size(q)
