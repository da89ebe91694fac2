"""Reranking, merging of sub-queries, judging and repeating weak retrievals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import querytext
from .fusion import adaptive_weights, fuse, top
from .lexical import overlap


def rerank(hits: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap, query: str = "query", text: str = "text", digits: int = 6) -> DataFrame:
    """The k best per query by a pair scorer: an expression or a pandas UDF of query and text. Equal scores keep the order of ranks."""
    scored = hits.withColumn("rerank_score", F.round(scorer(F.col(query), F.col(text)), digits)).withColumnRenamed("rank", "input_rank")
    return top(scored, "rerank_score", k, ties="input_rank")


def keep_order(hits: DataFrame, k: int) -> DataFrame:
    """What reranking without a scorer is: the first k."""
    return hits.filter(F.col("rank") <= k)


def merge_subqueries(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several sub-queries (root_id, sub_no, rank, doc_id, score): the first hit of each document, best 2k by score.

    Hits without a document are dropped.
    """
    seen = Window.partitionBy("root_id", "doc_id").orderBy("sub_no", "rank")
    first = hits.filter(F.col("doc_id").isNotNull()).withColumn("_n", F.row_number().over(seen)).filter("_n = 1").drop("_n")
    order = Window.partitionBy("root_id").orderBy(F.col("score").desc(), "sub_no", "rank", "doc_id")
    return first.withColumn("merged_rank", F.row_number().over(order)).filter(F.col("merged_rank") <= 2 * k)


def reflect(hits: DataFrame, query: str = "query", text: str = "text", score: str = "score") -> DataFrame:
    """query_id, score 0 to 10 and verdict: how many hits, how even the scores of the first five, how many query words the first three texts hold."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    head = F.when(F.col("rank") <= 5, F.col(score))
    # No accumulated list is longer than three texts.
    texts = F.collect_list(F.when(F.col("rank") <= 3, F.lower(text)))
    grouped = hits.groupBy("query_id").agg(F.first(words).alias("w"), F.count(F.lit(1)).alias("n"), F.max(head).alias("top"), F.avg(head).alias("mean"), texts.alias("t"))
    count = F.least(F.col("n") / 5, F.lit(1.0)) * 3
    quality = F.when(F.col("top") > 0, 2.0 + 2 * F.col("mean") / F.col("top")).otherwise(F.lit(0.0))
    covered = F.size(F.filter("w", lambda w: F.exists("t", lambda t: t.contains(w))))
    coverage = F.when(F.size("w") > 0, covered / F.size("w") * 3).otherwise(F.lit(0.0))
    total = F.round(count + quality + coverage, 6)
    return grouped.select("query_id", total.alias("reflection"), ((total >= 5) | ((F.col("n") >= 3) & (F.col("top") > 0))).alias("relevant"))


def retry_weak(queries: DataFrame, hits: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[Column], Column]) -> DataFrame:
    """Hits of the queries that did well, and of the others retrieved again with a rewritten text. A query without hits is weak."""
    # Both are read several times.
    hits = cut(hits)
    verdict = cut(reflect(hits.join(queries.select("query_id", "query"), "query_id")))
    weak = queries.join(verdict.filter("relevant"), "query_id", "left_anti").withColumn("query", rewrite(F.col("query")))
    good = hits.join(verdict.filter("relevant").select("query_id"), "query_id", "left_semi")
    again = retrieve(weak)
    return good.withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)), allowMissingColumns=True)


def retrieve(queries: DataFrame, vector: Callable[[DataFrame, int], DataFrame] | None, text: Callable[[DataFrame, int], DataFrame] | None, texts: DataFrame, k: int, method: str = "hybrid", use_rerank: bool = True, weights: dict[str, float] | None = None) -> DataFrame:
    """The whole path for a table of questions (query_id, query): 3k candidates of each list, fusion, rerank, best k.

    method is vector, text or hybrid; texts: doc_id, text. query_id, doc_id, rank, score.
    """
    lists = {n: f(queries, 3 * k) for n, f in (("vector", vector), ("text", text)) if f is not None and method in (n, "hybrid")}
    if not lists:
        raise ValueError(f"no retriever for method {method!r}")
    hits = next(iter(lists.values())) if len(lists) == 1 else fuse(lists, weights, 3 * k).select("query_id", "doc_id", "rank", F.col("rrf_score").alias("score"))
    if not use_rerank:
        return hits.filter(F.col("rank") <= k)
    named = hits.join(queries.select("query_id", "query"), "query_id").join(texts.select("doc_id", "text"), "doc_id")
    return rerank(named, k).select("query_id", "doc_id", "rank", F.col("rerank_score").alias("score"))


# Terms that make a question one about a known matter.
KNOWN_TERMS = ("diabetes", "cancer", "treatment", "symptoms", "diagnosis", "糖尿病", "癌症", "治疗", "症状", "诊断")


def ensemble(queries: DataFrame, vector: Callable[[DataFrame, int], DataFrame], text: Callable[[DataFrame, int], DataFrame], k: int, dictionary: querytext.Dictionary = querytext.SYNONYMS, abbreviations: dict[str, str] = querytext.ABBREVIATIONS, terms: tuple[str, ...] = KNOWN_TERMS) -> DataFrame:
    """Three lists fused by weights that fit the query's shape: query_id, doc_id, rank, rrf_score and each list's rank and score.

    The lists: 3k by the vector of the query with its abbreviations spelt out, 2k by the
    vector of its first variant with a synonym, and 3k by the words of the enhanced query. A
    query without a variant has two lists and the weights for two. Weights belong to names.
    """
    plain = queries.select("query_id", "query", querytext.expand_abbreviations(F.col("query"), abbreviations).alias("_plain"))
    asked = plain.select("query_id", F.col("_plain").alias("query"))
    variants = querytext.variants(F.col("_plain"), 2, dictionary)
    wider = plain.withColumn("_v", variants).filter(F.size("_v") > 1).select("query_id", F.col("_v")[1].alias("query"))
    rich = queries.select("query_id", querytext.enhanced(F.col("query"), dictionary, abbreviations).alias("query"))
    lists = {"vector": vector(asked, 3 * k), "expanded": vector(wider, 2 * k), "text": text(rich, 3 * k)}
    three, two = adaptive_weights(F.col("query"), terms), adaptive_weights(F.col("query"), terms, lists=2)
    has = F.size(querytext.variants(F.col("_plain"), 2, dictionary)) > 1
    weights = plain.withColumn("_three", three).withColumn("_two", two).withColumn("_has", has)
    of = lambda n: F.when(F.col("_has"), F.col(f"_three.{n}")).otherwise(F.lit(0.0) if n == "expanded" else F.col(f"_two.{n}"))
    return fuse(lists, weights.select("query_id", *[of(n).alias(n) for n in lists]), k)


def fetch(hits: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return hits.join(chunks, key)


def sample_corpus(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows that a rerun takes again."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), key)), key).limit(n)


def at_least(hits: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Hits of at least a similarity."""
    return hits.filter(F.col(score) >= least)
