"""An inverted file of vectors: cells kept as Parquet partitions, scanned by product-quantised codes, reranked on the vectors.

Vectors are scaled to unit length, so the inner product is the cosine. Cells are fitted by
spherical k-means; each vector is filed in the COPIES cells whose centres it points at most.
A copy holds a code of what its centre leaves over: its parts' nearest entries in small books,
a byte each. The vector itself lies once, in its first cell. A search reads the codes of the
cells it probes and nothing else (partitions are pruned by the query's own cells at run time),
keeps the best by code, and reads the vectors of those few for the exact score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..sources.tables import new_folder, released, stored

#: Cells that a vector is filed in; dimensions of a part; entries of a book; a search probes one cell in so many.
COPIES, PART, BOOK, SHARE = 3, 4, 256, 8
#: Cells at most (their centres are broadcast), and vectors that cells and books are fitted on at most.
CELLS, SAMPLE = 4096, 40_000
#: Candidates of a query that are reranked, for each one asked for, and at least.
WIDER, LEAST = 10, 100
#: Rows of a file of a cell, about.
FILE = 500_000
#: Rows that a scanning task holds before it drops what is out of a query's best.
HELD = 500_000
#: Vectors that are held against all centres at once; queries, and codes, of a row of those that meet.
SLICE, ROWS, CODES = 512, 2048, 1 << 18


@dataclass
class InvertedFile:
    """folder: the cells, as Parquet partitions; centres: cells x dimensions; books: parts x BOOK x PART; files: of each cell, when it is written."""

    folder: str
    centres: np.ndarray
    books: np.ndarray
    files: np.ndarray | None = None


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _matrix(v: pd.Series) -> np.ndarray:
    return np.vstack(v.to_numpy()).astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n centres that each row of x points at most, SLICE rows at a time."""
    parts = [np.argsort(-(x[at : at + SLICE] @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32) for at in range(0, len(x), SLICE)]
    return np.concatenate(parts)


def k_means(x: np.ndarray, k: int, spherical: bool, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k centres of the rows of x (fewer rows: the rows, repeated)."""
    c = x[np.random.default_rng(seed).permutation(max(k, len(x)))[:k] % len(x)].copy()
    for _ in range(rounds):
        sums, n = np.zeros_like(c), np.zeros(k)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            near = (part @ c.T - (0 if spherical else 0.5 * (c * c).sum(1))).argmax(1)
            np.add.at(sums, near, part)
            n += np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if spherical:
            c = _unit(c)
    return c


def _usable(df: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    v = F.col(vector_col).cast("array<float>")
    whole = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(whole).select(F.col(id_col).cast("bigint").alias(name), v.alias("v"))


def _parts(residual: np.ndarray) -> np.ndarray:
    """Rows cut into parts of PART dimensions, the last filled with zeros."""
    more = -residual.shape[1] % PART
    return np.pad(residual, ((0, 0), (0, more))).reshape(len(residual), -1, PART)


def fit(corpus: DataFrame, folder: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> InvertedFile:
    """Centres and books, fitted in tasks on the ``sample`` vectors of smallest hash; what comes to the driver is bounded by CELLS and BOOK."""
    base = _usable(corpus, id_col, vector_col, "id")
    n = base.count()
    k = cells or max(1, min(CELLS, n // 2, round(8 * n**0.5)))
    some = stored(base.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample), "sample")

    def coarse(f: pd.DataFrame) -> pd.DataFrame:
        x = _unit(_matrix(f.sort_values("id")["v"]))
        c = k_means(x, k, True)
        share = np.bincount(_nearest(x, c, 1)[:, 0], minlength=k) / len(x)
        return pd.DataFrame({"i": np.arange(len(c), dtype=np.int32), "v": list(c), "share": share})

    made = sorted(some.groupBy().applyInPandas(coarse, "i int, v array<float>, share double").collect()) if n else []
    centres = np.array([r["v"] for r in made], np.float32)
    files = np.ceil(np.maximum(1, np.array([r["share"] for r in made]) * n * COPIES / FILE)).astype(np.int64)

    def left_over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _unit(_matrix(f["v"]))
                p = _parts(x - centres[_nearest(x, centres, 1)[:, 0]])
                yield pd.DataFrame({"j": np.tile(np.arange(p.shape[1], dtype=np.int32), len(p)), "id": np.repeat(f["id"].to_numpy(), p.shape[1]), "v": list(p.reshape(-1, PART))})

    def book(f: pd.DataFrame) -> pd.DataFrame:
        c = k_means(_matrix(f.sort_values("id")["v"]), BOOK, False)
        return pd.DataFrame({"j": np.full(BOOK, f["j"].iloc[0], np.int32), "i": np.arange(BOOK, dtype=np.int32), "v": list(c)})

    rows = sorted(some.mapInPandas(left_over, "j int, id bigint, v array<float>").groupBy("j").applyInPandas(book, "j int, i int, v array<float>").collect()) if n else []
    released(some)
    return InvertedFile(folder, centres, np.array([r["v"] for r in rows], np.float32).reshape(-1, BOOK, PART), files)


def build(corpus: DataFrame, folder: str | None = None, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> InvertedFile:
    """Files every vector. Null, empty and zero vectors and those with parts that are null or not finite take no part; all have one length. Crowded cells are written by several tasks."""
    index = fit(corpus, folder or new_folder(corpus.sparkSession, "ivf"), cells, id_col, vector_col, sample)
    centres, books = index.centres, index.books
    copies = min(COPIES, len(centres))

    def filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = 0.5 * (books * books).sum(2)
        for f in frames:
            if not len(f):
                continue
            raw = _matrix(f["v"])
            x = _unit(raw)
            near = _nearest(x, centres, copies)
            for c in range(copies):
                p = _parts(x - centres[near[:, c]])
                code = np.stack([(p[:, j] @ books[j].T - half[j]).argmax(1) for j in range(p.shape[1])], 1).astype(np.uint8)
                yield pd.DataFrame({"cell": near[:, c], "home": near[:, 0], "id": f["id"], "code": [r.tobytes() for r in code], "v": list(raw) if c == 0 else None})

    rows = _usable(corpus, id_col, vector_col, "id").mapInPandas(filed, "cell int, home int, id bigint, code binary, v array<float>")
    spark = corpus.sparkSession
    files = F.array(*[F.lit(int(x)) for x in index.files]) if len(centres) else F.array(F.lit(1))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.pmod(F.xxhash64("id"), F.get(files, F.col("cell"))))
    dealt.write.partitionBy("cell").parquet(index.folder)
    spark.createDataFrame([(-1, 0, i, c.tolist()) for i, c in enumerate(centres)] + [(0, j, i, c.tolist()) for j, b in enumerate(books) for i, c in enumerate(b)], "kind int, j int, i int, v array<float>").coalesce(1).write.parquet(f"{index.folder}-model")
    return index


def load(spark: SparkSession, folder: str) -> InvertedFile:
    """An index that ``build`` wrote."""
    rows = sorted(spark.read.parquet(f"{folder}-model").collect(), key=lambda r: (r["kind"], r["j"], r["i"]))
    centres = np.array([r["v"] for r in rows if r["kind"] < 0], np.float32)
    return InvertedFile(folder, centres, np.array([r["v"] for r in rows if r["kind"] == 0], np.float32).reshape(-1, BOOK, PART))


def probes_of(index: InvertedFile) -> int:
    return max(1, len(index.centres) // SHARE)


def _asked(order: DataFrame, index: InvertedFile, probes: int) -> DataFrame:
    """cell: those that some of a batch of queries (q, v) probe."""
    centres = index.centres

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"cell": np.unique(_nearest(_unit(_matrix(f["v"])), centres, probes))})

    return order.mapInPandas(places, "cell int")


def pruned(spark: SparkSession, index: InvertedFile, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the given cells (a column cell): a semi join that Spark turns into a filter of partitions at run time. The list has at most one row a cell, so it is broadcast."""
    wanted = cells.filter("cell >= 0").select("cell").distinct()
    return spark.read.parquet(index.folder).select("cell", *columns).join(F.broadcast(wanted), "cell", "left_semi")


def _best(f: pd.DataFrame, most: int) -> pd.DataFrame:
    """Each query's ``most`` best rows, an entry once."""
    f = f.sort_values(["q", "approx", "id"], ascending=[True, False, True]).drop_duplicates(["q", "id"])
    return f.groupby("q", sort=False).head(most)


def search(queries: DataFrame, index: InvertedFile, k: int, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True, digits: int = 6) -> DataFrame:
    """query_id, doc_id, rank, score: the k best by cosine (at ``digits`` places; ties to the smaller id) among those filed in the ``probes`` cells nearest to a query.

    probes: one cell in SHARE where none is given. Queries with unusable vectors give no rows.
    """
    spark, probes, most = queries.sparkSession, probes or probes_of(index), max(LEAST, WIDER * k)
    order = _usable(queries, id_col, vector_col, "q")
    centres, books = index.centres, index.books
    if not len(centres):
        return spark.createDataFrame([], "query_id bigint, doc_id bigint, rank int, score double")
    asked = stored(_asked(order, index, probes).distinct(), "asked")

    def asking(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ROWS):
                part = f.iloc[at : at + ROWS]
                yield pd.DataFrame([(part["q"].to_numpy(np.int64).tobytes(), _unit(_matrix(part["v"])).tobytes())], columns=["qi", "qm"])

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def row() -> pd.DataFrame:
            f = pd.concat(held).sort_values(["cell", "id"])
            return pd.DataFrame([(f["cell"].to_numpy(np.int32).tobytes(), f["id"].to_numpy(np.int64).tobytes(), f["home"].to_numpy(np.int32).tobytes(), b"".join(f["code"]))], columns=["cells", "ids", "homes", "codes"])

        for f in frames:
            held.append(f)
            n += len(f)
            if n >= CODES:
                yield row()
                held, n = [], 0
        if n:
            yield row()

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cells, ids, homes, codes, qi, qm in zip(f["cells"], f["ids"], f["homes"], f["codes"], f["qi"], f["qm"], strict=True):
                cells, ids, homes = np.frombuffer(cells, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(homes, np.int32)
                code = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                q = np.frombuffer(qi, np.int64)
                x = np.frombuffer(qm, np.float32).reshape(len(q), -1)
                # What a query has of ``most`` better ones is dropped.
                held, rows, least = [], 0, np.full(len(q), -np.inf, np.float32)
                probed = np.zeros((len(centres), len(q)), bool)
                probed[_nearest(x, centres, probes), np.arange(len(q))[:, None]] = True
                edges = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
                for a, b in zip(edges, edges[1:], strict=False):
                    asks = np.flatnonzero(probed[cells[a]])
                    if not len(asks):
                        continue
                    # What the codes stand for: the centre and the books' entries.
                    near = centres[cells[a]] + books[np.arange(code.shape[1]), code[a:b]].reshape(b - a, -1)[:, : centres.shape[1]]
                    for at in range(0, len(asks), 256):
                        part = asks[at : at + 256]
                        s = x[part] @ near.T
                        if s.shape[1] > most:
                            i = np.repeat(np.arange(len(part)), most)
                            e = np.argpartition(-s, most - 1, axis=1)[:, :most].ravel()
                        else:
                            i, e = (y.ravel() for y in np.indices(s.shape))
                        keep = s[i, e] >= least[part[i]]
                        i, e = i[keep], e[keep]
                        held.append(pd.DataFrame({"q": q[part[i]], "id": ids[a + e], "home": homes[a + e], "approx": s[i, e], "at": part[i]}))
                        rows += len(i)
                        if rows > HELD:
                            held = [_best(pd.concat(held), most)]
                            last = held[0].groupby("at")["approx"].agg(["size", "min"])
                            last = last[last["size"] == most]
                            least[last.index] = np.maximum(least[last.index], last["min"])
                            if (rows := len(held[0])) > HELD // 2:
                                yield held.pop().drop(columns="at")
                                rows = 0
                if held:
                    yield _best(pd.concat(held), most).drop(columns="at")

    codes = pruned(spark, index, asked, ["id", "home", "code"])
    # As few rows as hold the codes: each meets all rows of queries.
    blocks = codes.repartition(max(1, -(-codes.count() // CODES))).mapInPandas(packed, "cells binary, ids binary, homes binary, codes binary")
    met = blocks.crossJoin(order.mapInPandas(asking, "qi binary, qm binary")).mapInPandas(scanned, "q bigint, id bigint, home int, approx float")
    if exclude_self:
        met = met.filter("q <> id")
    once = met.groupBy("q", "id").agg(F.max("approx").alias("approx"), F.max("home").alias("home"))
    short = once.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("approx").desc(), "id"))).filter(F.col("n") <= most)
    short = stored(short.select("q", "id", F.col("home").alias("cell")), "short")
    released(asked)
    vectors = pruned(spark, index, short, ["id", "v"]).filter("v is not null").select("cell", "id", F.col("v").alias("ve"))
    scored = short.join(vectors, ["cell", "id"]).join(order.withColumnRenamed("v", "vq"), "q").select("q", "id", F.round(cosine(F.col("vq").cast("array<double>"), F.col("ve").cast("array<double>")), digits).alias("score")).dropDuplicates(["q", "id"])
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("id").alias("doc_id"), "rank", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, recall (the share of ``exact``'s neighbours whose score ``found`` reaches: a tie counts)."""
    least = exact.groupBy("query_id").agg(F.min("score").alias("_least"), F.count(F.lit(1)).alias("_n"))
    hits = found.join(least, "query_id").filter(F.col("score") >= F.col("_least") - 1e-6).groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    return least.join(hits, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), (F.sum(F.least("_n", F.coalesce("_hits", F.lit(0)))) / F.sum("_n")).alias("recall"))
