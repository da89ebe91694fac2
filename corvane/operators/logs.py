"""Log and corpus analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import running


def query_stats(log: DataFrame, recall: Column, latency: Column, results: str = "num_results") -> DataFrame:
    """One row of count and means; no row for an empty log."""
    return log.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(results), 6).alias("mean_results"), F.round(F.avg(recall), 6).alias("mean_recall"), F.round(F.avg(latency), 6).alias("mean_latency")).filter("queries > 0")


def latest(df: DataFrame, ts: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(1)


def collection_stats(df: DataFrame, bytes_of: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"), F.round(F.sum(bytes_of) / (1024 * 1024), 6).alias("size_mb"))


def latency_summary(df: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """Mean, p50, p95, p99 (linear interpolation) and qps = 1000 / mean; approximate percentiles on request.

    Exact ones are read off one distributed sort at the places they lie between, so that no
    task holds a group's values. Groups without a value have nulls.
    """
    ps = (50, 95, 99)
    means = [F.round(F.avg(value), 6).alias("mean"), F.round(1000 / F.avg(value), 6).alias("qps")]
    if not exact:
        return df.groupBy(*by).agg(means[0], *[F.round(F.percentile_approx(value, p / 100, 10_000), 6).alias(f"p{p}") for p in ps], means[1])
    totals = df.groupBy(*by).agg(*means, F.count(value).alias("_n")).withColumnsRenamed({c: f"_{c}" for c in by})
    placed = running(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")), [*[F.col(c).asc_nulls_first() for c in by], F.col("_v").asc()])
    firsts = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    same = lambda: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    at = {p: (F.col("_n") - 1) * (p / 100) for p in ps}
    told = totals.join(firsts, [totals[f"_{c}"].eqNullSafe(firsts[f"_{c}"]) for c in by], "left").select(*[totals[f"_{c}"] for c in by], "mean", "qps", "_n", "_first")
    i = F.col("_place") - F.col("_first")
    near = F.lit(False)
    for p in ps:
        near = near | (i == F.floor(at[p])) | (i == F.ceil(at[p]))
    # Six rows a group at most.
    picked = placed.join(told.select(*[f"_{c}" for c in by], "_n", "_first"), same()).filter(near)
    of = lambda p, end: F.max(F.when(i == end(at[p]), F.col("_v")))
    between = lambda p: of(p, F.floor) + (of(p, F.ceil) - of(p, F.floor)) * F.max(at[p] - F.floor(at[p]))
    values = picked.groupBy(*by).agg(*[F.round(between(p), 6).alias(f"p{p}") for p in ps])
    return told.join(values, same(), "left").select(*[F.col(f"_{c}").alias(c) for c in by], "mean", *[f"p{p}" for p in ps], "qps")


def length_by_group(df: DataFrame, text: str, by: str) -> DataFrame:
    n = F.length(text)
    return df.groupBy(by).agg(F.round(F.avg(n), 6).alias("mean_len"), F.max(n).alias("max_len"), F.min(n).alias("min_len"))


def count_by_group(df: DataFrame, text: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length(text)), 6).alias("mean_len")).orderBy(F.col("n").desc(), by)


def buckets(df: DataFrame, value: str, by: list[str], bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts up to each bound, with the total and sum, as a histogram metric has them."""
    le = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]))
    wide = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("total"), F.round(F.sum(value), 6).alias("sum"))
    return wide.select(*by, "total", "sum", le.alias("x")).select(*by, "total", "sum", "x.*")


def counters(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def gauges(df: DataFrame, value: str, ts: str, by: list[str], tie: str | None = None) -> DataFrame:
    """The latest value of each label."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(ts, tie) if tie else F.col(ts)).alias("value"))


def hit_rate(df: DataFrame, hit: Column, by: list[str]) -> DataFrame:
    """Hits, misses and the rate in per cent to two places; 0 without traffic."""
    c = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))
    return c.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.round(100 * F.col("hits") / (F.col("hits") + F.col("misses")), 2)).otherwise(F.lit(0.0)))


def topic_bytes(df: DataFrame, topic: str, bytes_of: Column | None = None, target_mb: float = 50.0) -> DataFrame:
    """JSON bytes of each topic and whether it has its share; the list's own punctuation is not counted."""
    size = F.octet_length(F.to_json(F.struct("*"))) if bytes_of is None else bytes_of
    return df.groupBy(topic).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).withColumn("complete", F.col("bytes") >= target_mb * 1024 * 1024)


def topic_quota(df: DataFrame, topic: str, order: str, bytes_of: Column, target: int, batch: int = 200) -> DataFrame:
    """Rows of each topic in batches until its bytes reach the target: the batch that reaches it is the last kept.

    Rows are numbered in a sort over all topics, so that a large topic is in no single task.
    """
    slim = df.select(F.col(topic).alias("_t"), F.col(order).alias("_o"), bytes_of.alias("_n"))
    placed = running(slim, [F.col("_t").asc_nulls_last(), F.col("_o").asc()])
    starts = placed.groupBy(F.col("_t").alias("_s")).agg(F.min("_place").alias("_first"))
    numbered = placed.join(starts, F.col("_t").eqNullSafe(F.col("_s"))).select("_t", "_o", "_n", F.floor((F.col("_place") - F.col("_first")) / batch).alias("_b"))
    sums = running(numbered.groupBy("_t", "_b").agg(F.sum("_n").alias("_sum")), [F.col("_t").asc_nulls_last(), F.col("_b").asc()], {"_upto": F.coalesce("_sum", F.lit(0))})
    heads = sums.groupBy(F.col("_t").alias("_s")).agg(F.min("_upto").alias("_head"))
    kept = sums.join(heads, F.col("_t").eqNullSafe(F.col("_s"))).filter(F.col("_upto") - F.col("_head") < target).select(F.col("_t").alias("_kt"), F.col("_b").alias("_kb"))
    rows = numbered.join(kept, F.col("_t").eqNullSafe(F.col("_kt")) & (F.col("_b") == F.col("_kb")), "left_semi").select("_t", "_o")
    return df.join(rows, F.col(topic).eqNullSafe(F.col("_t")) & (F.col(order) == F.col("_o")), "left_semi")


def pass_summary(df: DataFrame, component: str, passed: Column) -> DataFrame:
    return df.groupBy(component).agg(F.count(F.lit(1)).alias("checks"), F.count_if(passed).alias("passed")).withColumn("ok", F.col("checks") == F.col("passed"))


def throughput(rows: DataFrame) -> DataFrame:
    """(method, n, seconds) -> rows per second, and the ratio to the slowest."""
    rate = rows.withColumn("rate", F.round(F.col("n") / F.col("seconds"), 6))
    return rate.withColumn("ratio", F.round(F.col("rate") / F.min("rate").over(Window.partitionBy(F.lit(1))), 6))
