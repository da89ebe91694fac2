"""Embedding, exact nearest neighbours, reuse of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vector import cosine, dot

#: Vectors of a block: blocks of queries meet blocks of entries.
QUERY_BLOCK = 4096


def hashed_terms(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``key``, embedding: term frequencies hashed to ``dim`` places with unit length; null for a text without tokens.

    The default encoder where no model is given: built-in functions only.
    """
    place = F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("bigint") % dim
    counts = df.select(key, F.explode(tokens(F.col(text))).alias("t")).groupBy(key, place.cast("int").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    vectors = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    made = vectors.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.col("l")).alias("embedding"))
    return df.select(key).join(made, key, "left")


def encode(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """``key``, embedding by a caller's model: a function from texts to a matrix. Blank texts stay, with a null vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list = [None] * len(f)
            at = [i for i, t in enumerate(f["t"]) if t and t.strip()]
            for b in range(0, len(at), batch):
                v = np.asarray(encoder([f["t"].iloc[i] for i in at[b : b + batch]]), float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, row in zip(at[b : b + batch], v, strict=True):
                    out[i] = row
            yield pd.DataFrame({"k": f["k"], "embedding": out})

    base = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return base.mapInPandas(run, f"k {base.schema['k'].dataType.simpleString()}, embedding array<double>").withColumnRenamed("k", key)


def encode_missing(df: DataFrame, stored: DataFrame, key: str, text: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows without a stored vector, encoded: resumes by key, whatever the order of rows."""
    return embed(df.join(stored.select(key), key, "left_anti"))


def encode_with_reuse(df: DataFrame, stored: DataFrame, text: str, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``text``, embedding, hit of all distinct texts, and one row of hits and misses. stored: text, embedding."""
    distinct = df.select(text).distinct()
    hits = distinct.join(stored, text).select(text, "embedding", F.lit(True).alias("hit"))
    misses = embed(distinct.join(stored.select(text), text, "left_anti")).select(text, "embedding", F.lit(False).alias("hit"))
    both = hits.unionByName(misses)
    return both, both.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def _packed(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (id, v) as blocks of at most QUERY_BLOCK: the ids and the matrix of vectors, as bytes. All vectors have one length."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), QUERY_BLOCK):
                part = f.iloc[at : at + QUERY_BLOCK]
                yield pd.DataFrame([[part["id"].to_numpy(np.int64).tobytes(), np.vstack(part["v"].to_numpy()).astype(float).tobytes()]], columns=names)

    return df.mapInPandas(pack, ", ".join(f"{n} binary" for n in names))


def _near_best(s: np.ndarray, m: int, within: float) -> np.ndarray:
    """Where a row's scores reach its m-th best, or are within rounding of it."""
    if s.shape[1] <= m:
        return np.ones(s.shape, bool)
    return s >= np.partition(s, s.shape[1] - m, axis=1)[:, [s.shape[1] - m]] - within


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "cosine", exclude_self: bool = True, digits: int = 6, slack: int = 8) -> DataFrame:
    """query_id, doc_id, rank, score: the k nearest of every query, ties (at ``digits`` places) to the smaller id.

    Equal vectors are one entry with their k + 1 smallest ids. Blocks of queries are joined with
    blocks of entries in the tasks, and every entry whose score is within the rounding of a
    query's (k + slack)-th best stays, however many tie. Scores of the finalists are taken anew in a fixed order of summation.
    """
    order = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v")).filter("v is not null and size(v) > 0 and q is not null")
    base = corpus.select(F.col(id_col).alias("c"), F.col(vector_col).alias("v")).filter("v is not null and size(v) > 0 and c is not null")
    copies = base.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("c"))).filter(F.col("n") <= k + 1)
    members = copies.select("c", F.min("c").over(Window.partitionBy("v")).alias("e"))
    entries = copies.filter("n = 1").select(F.col("c").alias("e"), "v")
    within = 2 * 10.0**-digits
    most = k + slack

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for qi, qm, ei, em in zip(f["qi"], f["qm"], f["ei"], f["em"], strict=True):
                ids, entry = np.frombuffer(qi, np.int64), np.frombuffer(ei, np.int64)
                m, x = np.frombuffer(qm).reshape(len(ids), -1), np.frombuffer(em).reshape(len(entry), -1)
                if metric == "cosine":
                    m, x = (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300) for y in (m, x))
                s = m @ x.T
                i, j = np.nonzero(_near_best(s, most, within))
                yield pd.DataFrame({"q": ids[i], "e": entry[j], "s": s[i, j]})

    both = _packed(order.select(F.col("q").cast("bigint").alias("id"), "v"), ["qi", "qm"]).crossJoin(_packed(entries.select(F.col("e").cast("bigint").alias("id"), "v"), ["ei", "em"]))
    found = both.mapInPandas(search, "q bigint, e bigint, s double")
    # An entry's score at its place bounds what may still be among the best: ties beyond it stay.
    best = Window.partitionBy("q").orderBy(F.col("s").desc(), "e")
    last = Window.partitionBy("q")
    short = found.withColumn("n", F.row_number().over(best)).withColumn("least", F.min(F.when(F.col("n") <= most, F.col("s"))).over(last)).filter(F.col("s") >= F.col("least") - within)
    measure = cosine if metric == "cosine" else dot
    scored = short.select("q", "e").join(entries.withColumnRenamed("v", "ve"), "e").join(order.withColumnRenamed("v", "vq"), "q").select("q", "e", F.round(measure(F.col("vq"), F.col("ve")), digits).alias("score")).join(members, "e").select("q", "c", "score")
    if exclude_self:
        scored = scored.filter("q <> c")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "c"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("c").alias("doc_id"), "rank", "score")
