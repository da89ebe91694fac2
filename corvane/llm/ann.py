"""Approximate nearest neighbours (largest inner product) by shifted space-filling curves.

Each of CURVES curves turns the vectors by a random rotation of its own, projects them onto
the faces of a cube (a vector belongs to the face of its largest coordinate, positive or
negative) and orders every face along a Hilbert curve through a few other coordinates,
shifted at random. Spark range-partitions and sorts all curves; the order is dealt in windows.
A query enters at its place on the faces that it points at most, over all curves (``probes``
of them), and is compared with its own window and both neighbours there; the windows' best
are merged, and the best of all are reranked on the original vectors in double precision.

Windows grow with the square root of the rows, so that recall holds as the table grows, and
the work of a query with them.

Lengths: vectors are dealt in bands of norms a factor of two apart, each with curves of its
own, for what is nearest by angle among longer vectors is no rule for shorter ones. A query
passes over bands whose longest vector cannot reach its k-th best score among the LONGEST
vectors of all: nothing is lost by that.

Equal vectors are one entry of the index, with their k + 1 smallest ids: a vector that a
third of all rows share makes no window larger. Nothing is fitted to the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running, stored

#: Curves; places a query enters them at in each band; coordinates of a face's Hilbert curve and bits of each; faces at most: twice so many projected coordinates.
CURVES, PROBES, DIMENSIONS, BITS, PROJECTED = 32, 64, 8, 7, 64
#: A window of n entries has GROWTH * sqrt(n) of them, LEAST_WINDOW at least. Entries that a task's group of windows aims at, and queries it has at most.
GROWTH, LEAST_WINDOW, GROUP_ENTRIES, GROUP_QUERIES = 0.4, 96, 4096, 2048
#: Bands of norms; vectors of largest norm that bound the scores.
BANDS, LONGEST = 16, 2048
#: Scores in windows are of components rounded to eight bits. Every candidate stays that is within so many standard deviations of that rounding of a k-th best score.
DEVIATIONS = 4
#: Queries whose entrances are looked up at once.
ENTERED = 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (rows of ``cells``, each of ``bits`` bits)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(len(x)):
            on = (x[i] >> level) & 1
            swap = (x[0] ^ x[i]) & low & (on - 1)
            x[0] = x[0] ^ swap ^ (low & -on)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= ((1 << level) - 1) & -((x[-1] >> level) & 1)
    key = np.zeros(len(cells), np.int64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | (((v ^ flip) >> level) & 1)
    return key


def valid(vector: Column) -> Column:
    """True of vectors that take part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@lru_cache(maxsize=4)
def turns(length: int, curves: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For every curve a random projection (orthonormal columns) and a shift."""
    rng = np.random.default_rng([seed, length])
    used = min(length, PROJECTED)
    return [np.linalg.qr(rng.normal(size=(length, used)))[0] for _ in range(curves)], rng.random((curves, DIMENSIONS)) / 2


def on_face(y: np.ndarray, face: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected vectors on one face each: the coordinates after the face's own, over that."""
    d = y.shape[1]
    used = min(DIMENSIONS, d)
    at = np.arange(len(y))
    axis = face % d
    top = np.maximum(np.abs(y[at, axis]), 1e-300)
    other = y[at[:, None], (axis[:, None] + 1 + np.arange(used)) % d] / top[:, None]
    u = np.clip((other + 1) / 2, 0, 1)
    cells = np.minimum(((u / 2 + shift[:used]) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_keys(cells, BITS)


def packed(x: np.ndarray) -> list[bytes]:
    """Vectors as a scale (four bytes) and components of eight bits."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    return [np.float32(s).tobytes() + r.tobytes() for s, r in zip(scale, np.rint(x / scale[:, None]).astype(np.int8), strict=True)]


def unpacked(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their scales."""
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale, scale[:, 0]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, probes: int = PROBES, growth: float = GROWTH, least_window: int = LEAST_WINDOW, longest: int = LONGEST, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row for which ``queries`` (over ``vectors``) holds.

    Nearest first, ties to the smaller id; a query's own row is no candidate; all candidates
    if there are fewer than k. Rows with a null id or a vector that is null, zero or holds
    null or non-finite components take no part. Vectors of different lengths have no inner
    product: each meets those of its own length. Of rows with the same id the smallest
    vector counts. Empty input gives no rows.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & valid(F.col(vector_col))).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("h", F.xxhash64("v")))
    copies = Window.partitionBy("h", "v").orderBy("id")
    ids = cut(rows.select("id", "h", "v", F.row_number().over(copies).alias("n")).filter(F.col("n") <= k + 1))
    members = cut(ids.select("id", F.min("id").over(Window.partitionBy("h", "v")).alias("e")))
    single = ids.filter("n = 1").select(F.col("id").alias("e"), "h", "v", F.size("v").alias("length"), F.sqrt(dot(F.col("v"), F.col("v"))).alias("norm"))
    asked = cut(rows.filter("q").select(F.col("id").alias("query_id"), "h", "v").join(single.select("e", "h", "v"), ["h", "v"]).select("query_id", "e"))

    most = single.groupBy("length").agg(F.max("norm").alias("_most"))
    band = F.least(F.lit(BANDS - 1), F.floor(F.log2(F.col("_most") / F.col("norm")))).cast("int")
    entries = cut(single.drop("h").join(F.broadcast(most), "length").withColumn("band", band).drop("_most"))
    # At most BANDS rows a length.
    window = F.greatest(F.lit(least_window), F.ceil(growth * F.sqrt(F.col("n"))))
    bands = cut(entries.groupBy("length", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("ceiling")).withColumn("window", window).withColumn("probes", F.least(F.lit(probes), F.ceil(2 * F.col("n") / F.col("window"))).cast("int")))

    queried = entries.join(asked.select("e").distinct(), "e", "left_semi").select("e", "length", "norm", "v")
    entered = _entrances(_bounded(queried, entries, bands, k, longest), bands, curves, seed)
    # Written once: range partitioning reads them twice, to sample and to sort.
    listed = stored(_listed(entries, curves, seed).unionByName(entered), "curves")
    # Places on the sorted curves count candidates (kind 0) only.
    order = [F.col(c).asc() for c in ("curve", "length", "band", "face", "key", "e", "kind")]
    placed = running(listed, order, {"ahead": 1 - F.col("kind")}).drop("_place", "face", "key")
    starts = placed.groupBy("curve", "length", "band").agg(F.min("ahead").alias("first"))
    w = F.floor((F.col("ahead") - F.col("first")) / F.col("window"))
    # Windows go in groups of neighbours; each group also has the window before it and the one after.
    many = F.ceil(GROUP_ENTRIES / F.col("window"))
    windowed = placed.join(F.broadcast(starts), ["curve", "length", "band"]).join(F.broadcast(bands.select("length", "band", "window")), ["length", "band"]).withColumn("w", w).withColumn("many", many)
    groups = lambda *ws: F.explode(F.array_distinct(F.array(*[F.floor(x / F.col("many")) for x in ws])))
    key = ["curve", "length", "band", "g"]
    asks = windowed.filter("kind = 1").withColumn("g", groups(F.col("w"))).select(*key, "w", "e")
    # A group with very many queries is compared in parts.
    parts = asks.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).alias("parts"))
    held = windowed.filter("kind = 0").withColumn("g", groups(F.col("w") - 1, F.col("w"), F.col("w") + 1)).select(*key, "w", "e").join(parts, key)
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    asks = asks.join(parts, key).withColumn("part", F.pmod(F.xxhash64("e"), F.col("parts")))
    both = held.select(*key, "part", "w", "e", F.lit(0).alias("kind")).unionByName(asks.select(*key, "part", "w", "e", F.lit(1).alias("kind")))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [packed(np.array([v], float))[0] for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["e", "x"])

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        base, q = frame[frame.kind == 0].sort_values(["w", "e"]), frame[frame.kind == 1].sort_values("w")
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32))]
        if len(base) and len(q):
            (x, sx), (y, sy), at, e = unpacked(base.x), unpacked(q.x), base.w.to_numpy(), base.e.to_numpy()
            nx, ny = (x * x).sum(1), (y * y).sum(1)
            windows, first, count = np.unique(q.w.to_numpy(), return_index=True, return_counts=True)
            for w, i, n in zip(windows.tolist(), first.tolist(), count.tolist(), strict=True):
                a, b = np.searchsorted(at, [w - 1, w + 2])
                if a == b:
                    continue
                s = y[i : i + n] @ x[a:b].T
                margin = DEVIATIONS * np.sqrt((ny[i : i + n] * sx[a:b].max() ** 2 + nx[a:b].max() * sy[i : i + n] ** 2) / 12)
                kth = np.partition(s, b - a - min(k + 1, b - a), axis=1)[:, b - a - min(k + 1, b - a)]
                r, c = np.nonzero(s >= (kth - 2 * margin)[:, None])
                out.append((q.e.to_numpy()[i : i + n][r], e[a:b][c], s[r, c], margin[r]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("q", "e", "s", "m"), zip(*out, strict=True), strict=True)})

    short = stored(entries.select("e", "v").mapInArrow(small, "e bigint, x binary"), "vectors")
    found = both.join(short, "e").groupBy(*key, "part").applyInPandas(best, "q bigint, e bigint, s float, m float")
    merged = found.groupBy("q", "e").agg(F.max("s").alias("s"), F.max("m").alias("m"))
    top = Window.partitionBy("q").orderBy(F.col("s").desc(), "e")
    every = Window.partitionBy("q")
    ranked = merged.withColumn("n", F.row_number().over(top)).withColumn("kth", F.min(F.when(F.col("n") <= k + 1, F.col("s"))).over(every)).withColumn("m", F.max("m").over(every))
    finalists = ranked.filter(F.col("s") >= F.col("kth") - 2 * F.col("m"))
    scored = finalists.join(entries.select("e", F.col("v").alias("ve")), "e").join(entries.select(F.col("e").alias("q"), F.col("v").alias("vq")), "q").select("q", "e", dot(F.col("vq"), F.col("ve")).alias("score"))
    order_of = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    listed = scored.join(members, "e").withColumn("n", F.row_number().over(order_of)).filter(F.col("n") <= k + 1).select("q", "id", "score")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    answers = asked.join(listed, asked["e"] == listed["q"]).filter("id <> query_id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _bounded(queried: DataFrame, entries: DataFrame, bands: DataFrame, k: int, longest: int) -> DataFrame:
    """``queried`` with least: a score that k other entries are known to reach, by the ``longest`` vectors of largest norm (of the commonest length; null for others). It only serves to pass over bands."""
    common = bands.groupBy("length").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bands")).orderBy(F.col("n").desc(), "length").first()
    if common is None or common["bands"] < 2:
        return queried.withColumn("least", F.lit(None).cast("double"))
    some = entries.filter(F.col("length") == common["length"]).orderBy(F.col("norm").desc(), "e").limit(longest).select("e", "v").toPandas()
    who, known, length = some.e.to_numpy(), np.vstack(some.v.to_numpy()), common["length"]

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            least = np.full(len(f), np.nan)
            at = np.flatnonzero(f.length.to_numpy() == length)
            if len(at) and len(who) > k:
                s = np.vstack(f.v.iloc[at].to_numpy()) @ known.T
                s[f.e.to_numpy()[at][:, None] == who[None, :]] = -np.inf
                least[at] = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            yield f.assign(least=least)

    return queried.mapInPandas(scored, "e bigint, length int, norm double, v array<double>, least double").withColumn("least", F.nanvl("least", F.lit(None)))


LISTED = "curve int, length int, band int, face int, key bigint, e bigint, kind int"


def _listed(entries: DataFrame, curves: int, seed: int) -> DataFrame:
    """Every entry's place on every curve."""

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, f in frame.groupby("length"):
                x = np.vstack(f.v.to_numpy())
                rotations, shifts = turns(int(length), curves, seed)
                for c in range(curves):
                    y = x @ rotations[c]
                    face = np.abs(y).argmax(1)
                    face = face + y.shape[1] * (y[np.arange(len(y)), face] < 0)
                    yield pd.DataFrame({"curve": c, "length": length, "band": f.band.to_numpy(), "face": face, "key": on_face(y, face, shifts[c]), "e": f.e.to_numpy(), "kind": 0})

    return entries.select("e", "length", "band", "v").mapInPandas(keyed, LISTED)


def _entrances(queried: DataFrame, bands: DataFrame, curves: int, seed: int) -> DataFrame:
    """Where every query enters the curves of each band that may hold one of its nearest: on the faces it points at most."""
    reach = F.col("least").isNull() | (F.col("norm") * F.col("ceiling") * (1 + 1e-9) >= F.col("least"))
    into = queried.join(F.broadcast(bands.select("length", "band", "ceiling", "probes")), "length").filter(reach)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, f in frame.groupby("length"):
                rotations, shifts = turns(int(length), curves, seed)
                for at in range(0, len(f), ENTERED):
                    part = f.iloc[at : at + ENTERED]
                    x, probes = np.vstack(part.v.to_numpy()), part.probes.to_numpy()
                    y = np.stack([x @ r for r in rotations], axis=1)
                    d = y.shape[2]
                    pick = np.argsort(-np.concatenate([y, -y], axis=2).reshape(len(x), -1), axis=1, kind="stable")[:, : probes.max()]
                    row, slot = np.nonzero(np.arange(pick.shape[1]) < probes[:, None])
                    curve, face = pick[row, slot] // (2 * d), pick[row, slot] % (2 * d)
                    key = np.empty(len(row), np.int64)
                    for c in np.unique(curve):
                        on = curve == c
                        key[on] = on_face(y[row[on], c], face[on], shifts[c])
                    yield pd.DataFrame({"curve": curve, "length": length, "band": part.band.to_numpy()[row], "face": face, "key": key, "e": part.e.to_numpy()[row], "kind": 1})

    return into.select("e", "length", "band", "probes", "v").mapInPandas(keyed, LISTED)
