"""Normalising, ranking and fusing scores of a table of hits (query_id, doc_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of the vector score, and the rank constant of reciprocal rank fusion.
ALPHA, RRF_K = 0.6, 60


def minmax(score: str, by: str = "query_id") -> Column:
    """Scaled to 0..1 per query. Where no score is positive the maximum counts as 1, and an empty range as 1: equal scores become 0."""
    w = Window.partitionBy(by)
    top = F.when(F.max(score).over(w) > 0, F.max(score).over(w)).otherwise(F.lit(1.0))
    low = F.min(score).over(w)
    return (F.col(score) - low) / F.when(top > low, top - low).otherwise(F.lit(1.0))


def rank_of(score: str, ties: str, by: str = "query_id") -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), ties))


def rrf_two(vector_rank: Column, text_rank: Column, alpha: float = ALPHA, k: int = RRF_K) -> Column:
    return alpha / (k + vector_rank) + (1 - alpha) / (k + text_rank)


def linear(vector: Column, text: Column, alpha: float = ALPHA) -> Column:
    return alpha * vector + (1 - alpha) * text


def top(df: DataFrame, score: str, k: int, by: str = "query_id", ties: str = "doc_id") -> DataFrame:
    return df.withColumn("rank", rank_of(score, ties, by)).filter(F.col("rank") <= k)


def hybrid(hits: DataFrame, k: int, alpha: float = ALPHA, use_rrf: bool = True, vector: str = "vector_score", text: str = "text_score", digits: int = 6) -> DataFrame:
    """Hits with both scores scaled and hybrid_score, best k per query. Equal scores keep the order of ids."""
    scaled = hits.withColumn("vector_norm", minmax(vector)).withColumn("text_norm", minmax(text))
    if use_rrf:
        scaled = scaled.withColumn("vector_rank", rank_of("vector_norm", "doc_id")).withColumn("text_rank", rank_of("text_norm", "doc_id"))
        scaled = scaled.withColumn("hybrid_score", F.round(rrf_two(F.col("vector_rank"), F.col("text_rank"), alpha), digits))
    else:
        scaled = scaled.withColumn("hybrid_score", F.round(linear(F.col("vector_norm"), F.col("text_norm"), alpha), digits))
    return top(scaled, "hybrid_score", k)


def fuse(lists: dict[str, DataFrame], weights: dict[str, float] | DataFrame | None, k: int, rrf_k: int = RRF_K, digits: int = 6) -> DataFrame:
    """Reciprocal rank fusion of named lists (query_id, doc_id, rank, score): each list's rank and score stay as columns.

    Weights belong to names, so a missing list takes no other's; without weights all count
    1; a table of weights has query_id and a column for each name. Hits without a document
    are skipped. query_id, doc_id, rank, rrf_score, <name>_rank, <name>_score.
    """
    each = weights if isinstance(weights, DataFrame) else None
    fixed = (lambda name: 1.0) if weights is None else (lambda name: 0.0) if each is not None else (lambda name: float(weights.get(name, 0.0) if weights else 1.0))
    tagged = None
    for name, df in lists.items():
        part = df.filter(F.col("doc_id").isNotNull()).select("query_id", "doc_id", "rank", "score", F.lit(name).alias("list"), F.lit(fixed(name)).alias("weight"))
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        raise ValueError("no lists")
    if each is not None:
        named = each.select(F.col("query_id").alias("_q"), F.create_map(*[x for n in lists for x in (F.lit(n), F.col(n).cast("double"))]).alias("_w"))
        tagged = tagged.join(named, F.col("query_id") == F.col("_q")).withColumn("weight", F.col("_w")[F.col("list")])
    of = lambda name, c: F.max(F.when(F.col("list") == name, F.col(c)))
    fused = tagged.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (rrf_k + F.col("rank"))), digits).alias("rrf_score"), *[x for n in lists for x in (of(n, "rank").alias(f"{n}_rank"), of(n, "score").alias(f"{n}_score"))])
    return top(fused, "rrf_score", k)


# List weights (vector, expanded, text) of short queries, of questions about a known term, and of others; of two lists (vector, text) for short queries and others.
SHORT, ABOUT, OTHER = (0.35, 0.25, 0.40), (0.35, 0.40, 0.25), (0.40, 0.35, 0.25)
SHORT_TWO, OTHER_TWO = (0.45, 0.55), (0.55, 0.45)
SHORT_WORDS = 3
QUESTION_WORDS = ("what", "how", "why", "when", "which")


def adaptive_weights(query: Column, terms: tuple[str, ...], lists: int = 3) -> Column:
    """Weights by the shape of the query, as a struct of list names: vector, expanded and text; or vector and text for two lists."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    known, question = F.lit(False), F.trim(query).endswith("?")
    for t in terms:
        known = known | F.lower(query).contains(t)
    for w in QUESTION_WORDS:
        question = question | query.startswith(w)
    of = lambda names, values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])
    if lists == 2:
        return F.when(words <= SHORT_WORDS, of(("vector", "text"), SHORT_TWO)).otherwise(of(("vector", "text"), OTHER_TWO))
    names = ("vector", "expanded", "text")
    return F.when(words <= SHORT_WORDS, of(names, SHORT)).when(question & known, of(names, ABOUT)).otherwise(of(names, OTHER))
