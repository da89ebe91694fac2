"""Filters, quality checks, deduplication by keys and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, first_text, unique_ratio
from ..sources.tables import cut

# Thresholds and patterns of the quality check.
MIN_ABSTRACT, MAX_ABSTRACT, MIN_TITLE = 100, 10000, 10
PHRASES = ("click here", "buy now", "free download")
LINK = r"https?://(?!www\.ncbi|pubmed|doi)"
CAPITALS = "[A-Z]{10,}"
REPEATED = r"(.)\1{5,}"


def keep_complete(df: DataFrame, columns: tuple[str, ...] = ("title", "abstract", "full_text"), text: str = "full_text", least: int = 100) -> DataFrame:
    """Rows with all columns non-null and a text of at least ``least`` characters."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df.filter(F.length(text) >= least)


def article_text(full: Column, title: Column, abstract: Column) -> Column:
    """The full text, or title, blank line and abstract where it is missing."""
    return first_text(full, F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(abstract, F.lit(""))))


def by_category(df: DataFrame, column: str, value: object, order: str, limit: int = 100) -> DataFrame:
    return df.filter(F.col(column) == value).orderBy(order).limit(limit)


def in_range(df: DataFrame, column: str, start: object = None, end: object = None) -> DataFrame:
    """Rows from start to end, both included; either may be left open."""
    if start is not None:
        df = df.filter(F.col(column) >= start)
    return df if end is None else df.filter(F.col(column) <= end)


def issues(title: Column, abstract: Column, key: Column, strict_reference: bool = False) -> Column:
    """Issue codes of an article, in the order of the checks; an article with an empty list passes.

    With a required field missing or empty only that is reported. strict_reference tests
    runs of ten letters of either case, as lower-casing before a caseless match does.
    """
    missing = lambda c: F.coalesce(c.cast("string") == "", F.lit(True))
    raw = F.concat_ws(" ", title, abstract)
    text = F.lower(raw)
    shout = text.rlike("[a-z]{10,}") if strict_reference else raw.rlike(CAPITALS)
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z]+", "")) / F.greatest(F.length(text), F.lit(1))
    required = F.array_compact(F.array(*[F.when(missing(c), F.lit(f"missing_{n}")) for n, c in (("pmid", key), ("title", title), ("abstract", abstract))]))
    found = F.array_compact(
        F.array(
            F.when(F.length(abstract) < MIN_ABSTRACT, F.lit("abstract_short")),
            F.when(F.length(abstract) > MAX_ABSTRACT, F.lit("abstract_long")),
            F.when(F.length(title) < MIN_TITLE, F.lit("title_short")),
            *[F.when(text.contains(p), F.lit(f"spam_{p.replace(' ', '_')}")) for p in PHRASES],
            F.when(text.rlike(LINK), F.lit("spam_link")),
            F.when(shout, F.lit("spam_capitals")),
            F.when(text.rlike(REPEATED), F.lit("spam_repeated")),
            F.when(letters < 0.5, F.lit("not_english")),
            F.when(unique_ratio(text) < 0.7, F.lit("repetitive")),
        )
    )
    return F.when(F.size(required) > 0, required).otherwise(found)


def quality_score(title: Column, abstract: Column, authors: Column | None = None, pub_date: Column | None = None, terms: tuple[Column, ...] = ()) -> Column:
    """0 to 100. Lists that are absent or empty cost as much as missing ones."""
    none = lambda c: F.lit(True) if c is None else F.coalesce(F.size(c) <= 0, F.lit(True))
    a, t = F.coalesce(abstract, F.lit("")), F.coalesce(title, F.lit(""))
    lacks_terms = F.lit(True)
    for c in terms:
        lacks_terms = lacks_terms & none(c)
    score = (
        F.lit(100.0)
        - F.when(F.length(a) < 200, 20).when(F.length(a) < 500, 10).otherwise(0)
        - F.when(F.length(t) < 20, 10).otherwise(0)
        - F.when(none(authors), 10).otherwise(0)
        - F.when(F.lit(True) if pub_date is None else F.coalesce(pub_date == "", F.lit(True)), 5).otherwise(0)
        - F.when(lacks_terms, 10).otherwise(0)
        - F.coalesce(F.greatest(F.lit(0.0), (0.5 - unique_ratio(F.concat_ws(" ", t, a))) * 30), F.lit(0.0))
        - F.when(F.size(F.split(a, "[.!?]", -1)) < 3, 15).otherwise(0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def issue_histogram(df: DataFrame, column: str = "issues", top: int = 10) -> DataFrame:
    return df.select(F.explode(column).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "issue").limit(top)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by ``order``: repeatable, unlike dropDuplicates."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def first_of_two_keys(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Rows that no earlier kept row equals in ``key`` or in the hash of ``text`` (``order`` is unique).

    A row dropped for one key does not use up the other, so this is a fixed point. Each
    round keeps the rows that come first among the undecided in both, and drops those that
    conflict with kept ones. A row with a single earlier rival is kept where that one is not:
    such rows form chains, which one round decides as a whole by pointer doubling, in as many
    steps as the logarithm of the longest. Rounds that are left follow rows with several
    earlier rivals, one of which waits for another. An empty text has no hash; null keys are equal.
    """
    hashed = df.select(F.col(order).alias("_o"), F.col(key).alias("_k"), F.when(F.coalesce(F.col(text), F.lit("")) != "", content_hash(F.col(text))).alias("_h"))
    return df.join(_first_of_both(hashed), F.col(order) == F.col("_keep"), "left_semi")


def _first_two(left: DataFrame, by: str, first: str, second: str) -> DataFrame:
    """``left`` with the first and second place among the rows of the same ``by``; null where ``by`` is null or there is none."""
    least = left.groupBy(F.col(by).alias("_x")).agg(F.min("_o").alias(first))
    met = left.join(least, F.col(by) == F.col("_x"), "left").drop("_x")
    next_ = met.filter(F.col("_o") > F.col(first)).groupBy(F.col(by).alias("_x")).agg(F.min("_o").alias(second))
    return met.join(next_, F.col(by) == F.col("_x"), "left").drop("_x")


def _first_of_both(hashed: DataFrame) -> DataFrame:
    """_keep: the places (_o) of the rows (_o, _k, _h) that stay."""
    # A null key counts as a key of its own, a null hash as none.
    left = cut(hashed.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col("_k").cast("string")), F.lit("null"))))
    kept = left.filter("false").select(F.col("_o").alias("_keep"))
    while not left.isEmpty():
        ranked = cut(_first_two(_first_two(left, "_k", "_a", "_a2"), "_h", "_b", "_b2"))
        first_k, first_h = F.col("_o") == F.col("_a"), F.coalesce(F.col("_o") == F.col("_b"), F.lit(True))
        one_k, one_h = F.col("_o") == F.col("_a2"), F.coalesce(F.col("_o") == F.col("_b2"), F.lit(False))
        sole = F.when(one_k & (first_h | (one_h & (F.col("_a") == F.col("_b")))), F.col("_a")).when(first_k & one_h, F.col("_b"))
        firsts = ranked.filter(first_k & first_h).select("_o")
        now = cut(firsts.unionByName(_along_chains(ranked.select("_o", sole.alias("_to")).filter("_to is not null"), firsts)))
        kept = kept.unionByName(now.select(F.col("_o").alias("_keep")))
        taken = left.join(now, "_o", "left_semi")
        rest = left.join(taken.select(F.col("_k").alias("_x")), F.col("_k") == F.col("_x"), "left_anti")
        left = cut(rest.join(taken.select(F.col("_h").alias("_x")).filter("_x is not null"), F.col("_h") == F.col("_x"), "left_anti"))
    return kept


def _along_chains(pointers: DataFrame, firsts: DataFrame) -> DataFrame:
    """_o of the rows that stay among those that point (_o, _to) to their single earlier rival, where the chain begins with one of ``firsts``."""
    chains = cut(pointers.withColumn("_odd", F.lit(True)))
    while True:
        ahead = chains.select(F.col("_o").alias("_p"), F.col("_to").alias("_far"), F.col("_odd").alias("_flip"))
        met = cut(chains.join(ahead, F.col("_to") == F.col("_p"), "left"))
        if met.filter("_p is not null").isEmpty():
            break
        chains = met.select("_o", F.coalesce("_far", "_to").alias("_to"), F.when(F.col("_p").isNull(), F.col("_odd")).otherwise(F.col("_odd") != F.col("_flip")).alias("_odd"))
    return chains.filter(~F.col("_odd")).join(firsts.select(F.col("_o").alias("_p")), F.col("_to") == F.col("_p"), "left_semi").select("_o")


def outlier_bounds(df: DataFrame, columns: list[str], k: float = 2.5) -> DataFrame:
    """metric, q1, q3, lower, upper: order statistics n div 4 and 3n div 4 (from 0), without interpolation.

    They come from a histogram of values, so the ordered window sees distinct values only.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("metric").orderBy("v")
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("metric")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q / 4), F.col("v")))
    q = run.groupBy("metric").agg(at(1).alias("q1"), at(3).alias("q3"))
    return q.select("metric", "q1", "q3", F.greatest(F.lit(0.0), F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"), (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))


def outlier_flags(df: DataFrame, columns: list[str], upper_only: tuple[str, ...] = (), k: float = 2.5) -> DataFrame:
    """``df`` with anomalies: the columns whose value is outside its bounds. The bounds are one row."""
    one = outlier_bounds(df, columns, k).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lower", "upper")))).alias("_bounds"))
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    bad = lambda c: (v(c) > F.col("_bounds")[c]["upper"]) | (F.lit(False) if c in upper_only else v(c) < F.col("_bounds")[c]["lower"])
    return df.crossJoin(F.broadcast(one)).withColumn("anomalies", F.array_compact(F.array(*[F.when(bad(c), F.lit(c)) for c in columns]))).drop("_bounds")


def clean_stats(df: DataFrame, order: str, key: str = "pmid", title: str = "title", abstract: str = "abstract", strict_reference: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and are no duplicates, with issues, score and anomalies; and one row of totals.

    Bounds of outliers are taken over all rows, before any is dropped.
    """
    lengths = ["abstract_length", "title_length"]
    checks = df.select(
        F.col(order).alias("_o"),
        F.col(key).alias("_k"),
        F.when(F.coalesce(F.col(abstract), F.lit("")) != "", content_hash(F.col(abstract))).alias("_h"),
        issues(F.col(title), F.col(abstract), F.col(key), strict_reference).alias("issues"),
        quality_score(F.col(title), F.col(abstract)).alias("score"),
        F.length(abstract).alias("abstract_length"),
        F.length(title).alias("title_length"),
    )
    # Texts are read once: what follows works on these few columns.
    flagged = cut(outlier_flags(cut(checks), lengths))
    passed = flagged.filter(F.size("issues") == 0)
    unique = passed.join(_first_of_both(passed.select("_o", "_k", "_h")), F.col("_o") == F.col("_keep"), "left_semi")
    totals = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("issues") == 0).alias("passed"), F.count_if(F.size("issues") > 0).alias("failed"))
    kept = unique.agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.size("anomalies") > 0).alias("anomalies"), F.round(F.avg("score"), 4).alias("mean_score"))
    rows = df.join(unique.select(F.col("_o").alias("_keep"), "issues", "score", *lengths, "anomalies"), F.col(order) == F.col("_keep")).drop("_keep")
    return rows, totals.crossJoin(kept).withColumn("duplicates", F.col("passed") - F.col("kept"))
