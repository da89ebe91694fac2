"""An exact join of vectors whose cosine reaches a threshold: pivots and the triangle inequality of angles rule blocks out.

Entries lie in blocks: their nearest pivot, and the ring of their angle to it. A query whose
angle to the pivot is further from a block's least and largest angle than the threshold's
angle cannot reach any entry there, by the triangle inequality, so no product with the
block's entries is made. Queries and entries (in order of their blocks) meet as matrices of
ROWS rows in a cross join of those; no query is written once for each block that it reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..sources.tables import released, stored
from .ivf import _unit

#: Pivots at most (with RINGS of each they bound what the driver and tasks hold of blocks), rows of a matrix, and queries that are held against all blocks at once.
PIVOTS, RINGS, ROWS, SLICE = 512, 24, 2048, 256
#: Room for rounding, in cosines and in angles.
NEAR, SLACK = 1e-6, 1e-6


def _usable(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))).select(F.col(id_col).cast("bigint").alias(name), v.alias("v"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.vstack(v.to_numpy()).astype(float)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def nearest_within(queries: DataFrame, entries: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """query_id, doc_id, score: the nearest entry of each query whose cosine (at ``digits`` places) is ``least`` or more, ties to the smaller id; and one row of pairs of queries and blocks, and of those compared.

    ``least`` is above 0 and at most 1. Null and zero vectors and such with null or NaN parts
    reach nothing. Equal vectors are one entry with their smallest id. All vectors have one
    length.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine is above 0 and at most 1")
    spark = queries.sparkSession
    order = _usable(queries, id_col, vector_col, "q")
    once = _usable(entries, id_col, vector_col, "e").groupBy("v").agg(F.min("e").alias("e"))
    held = stored(once, "entries")
    # Pivots: the entries of smallest hash, about twice the root of their number.
    n = held.count()
    most = max(1, min(PIVOTS, round(2 * n**0.5)))
    chosen = [r["v"] for r in held.orderBy(F.xxhash64("e"), "e").limit(most).collect()]
    nothing = "query_id bigint, doc_id bigint, score double"
    if not chosen:
        return spark.createDataFrame([], nothing), spark.createDataFrame([(0, 0)], "pairs bigint, compared bigint")
    pivots = _unit(np.array(chosen, float))
    reach = math.acos(max(-1.0, least - NEAR)) + SLACK
    wide = max(reach / 2, math.pi / RINGS)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _unit(_matrix(f["v"]))
                a = _angles(x, pivots)
                near = a.argmin(1)
                angle = a[np.arange(len(x)), near]
                yield pd.DataFrame({"e": f["e"], "v": list(x), "block": (near * (RINGS + 1) + (angle / wide).astype(int)).astype(np.int32), "angle": angle})

    dealt = stored(held.mapInPandas(placed, "e bigint, v array<double>, block int, angle double").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "e").sortWithinPartitions("block", "e"), "dealt")
    # At most PIVOTS x (RINGS + 1) rows.
    rows = dealt.groupBy("block").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy("block").collect()
    block = np.array([r["block"] for r in rows], np.int32)
    pivot, lo, hi = block // (RINGS + 1), np.array([r["lo"] for r in rows]), np.array([r["hi"] for r in rows])

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), SLICE):
                a = _angles(_unit(_matrix(f["v"].iloc[at : at + SLICE])), pivots)[:, pivot]
                yield pd.DataFrame({"n": [int((np.maximum(a - hi, lo - a) <= reach).sum())]})

    def asking(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                part = f.iloc[at : at + ROWS]
                yield pd.DataFrame([(part["q"].to_numpy(np.int64).tobytes(), _unit(_matrix(part["v"])).tobytes())], columns=["qi", "qm"])

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                part = f.iloc[at : at + ROWS]
                yield pd.DataFrame([(part["e"].to_numpy(np.int64).tobytes(), _matrix(part["v"]).tobytes(), part["block"].to_numpy(np.int32).tobytes())], columns=["ei", "em", "eb"])

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for qi, qm, ei, em, eb in zip(f["qi"], f["qm"], f["ei"], f["em"], f["eb"], strict=True):
                q, e, b = np.frombuffer(qi, np.int64), np.frombuffer(ei, np.int64), np.frombuffer(eb, np.int32)
                x, y = np.frombuffer(qm).reshape(len(q), -1), np.frombuffer(em).reshape(len(e), -1)
                edges = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)]
                out, best = [], np.full(len(q), least - NEAR)
                for first, last in zip(edges, edges[1:], strict=False):
                    k = np.searchsorted(block, b[first])
                    angle = _angles(x, pivots[pivot[k], None])[:, 0]
                    row = np.flatnonzero(np.maximum(angle - hi[k], lo[k] - angle) <= reach)
                    if not len(row):
                        continue
                    s = x[row] @ y[first:last].T
                    best[row] = np.maximum(best[row], s.max(1))
                    # A query's best so far, and what rounding may make equal to it.
                    i, j = np.nonzero((s >= least - NEAR) & (s >= best[row, None] - 2 * 10.0**-digits))
                    out.append(pd.DataFrame({"q": q[row[i]], "e": e[first + j], "s": s[i, j]}))
                if out:
                    yield pd.concat(out)

    asks = order.mapInPandas(asking, "qi binary, qm binary")
    blocks = dealt.select("e", "v", "block").mapInPandas(packed, "ei binary, em binary, eb binary")
    found = blocks.crossJoin(asks).mapInPandas(compared, "q bigint, e bigint, s double")
    top = found.withColumn("top", F.max("s").over(Window.partitionBy("q"))).filter(F.col("s") >= F.col("top") - 2 * 10.0**-digits).select("q", "e").distinct()
    near = stored(top, "near")
    scored = near.join(held.withColumnRenamed("v", "ve"), "e").join(order.withColumnRenamed("v", "vq"), "q").select("q", "e", F.round(cosine(F.col("vq"), F.col("ve")), digits).alias("score"))
    best = scored.filter(F.col("score") >= least).withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "e"))).filter("n = 1")
    all_pairs = order.agg((F.count(F.lit(1)) * len(rows)).alias("pairs"))
    report = stored(all_pairs.crossJoin(order.mapInPandas(reached, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))), "report")
    released(dealt)
    return best.select(F.col("q").alias("query_id"), F.col("e").alias("doc_id"), "score"), report
