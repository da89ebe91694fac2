"""Conversations and citations: (conv_id, turn, role, text) messages and (query_id, index, ...) contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The form of a citation tag, the snippet's length, the score above which an uncited context is reported.
TAG = r"(?i)\[(?:Document\s*)?(\d+)\]"
SNIPPET = 200
HIGH = 0.7


def last_turns(messages: DataFrame, max_turns: int) -> DataFrame:
    """The last 2 * max_turns messages of every conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * max_turns).drop("_n")


def _joined(messages: DataFrame, n: int, line: Column, sep: str, name: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return last.groupBy("conv_id").agg(F.array_join(lines, sep).alias(name))


def summaries(messages: DataFrame, n: int = 4, length: int = 100) -> DataFrame:
    """conv_id, summary: the last n messages, each a role and the beginning of its text."""
    role = F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Assistant"))
    return _joined(messages, n, F.concat(role, F.lit(": "), F.substring("text", 1, length)), "\n", "summary")


def questions_with_history(questions: DataFrame, messages: DataFrame, n: int = 4, length: int = 200) -> DataFrame:
    """(conv_id, question) with prompt: the last n messages before the question; the bare question where there are none."""
    role = F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Assistant"))
    history = _joined(messages, n, F.concat(role, F.lit(": "), F.substring("text", 1, length)), "\n", "_history")
    joined = questions.join(history, "conv_id", "left")
    return joined.withColumn("prompt", F.when(F.col("_history").isNull(), F.col("question")).otherwise(F.concat(F.col("_history"), F.lit("\nUser: "), F.col("question")))).drop("_history")


def rolling_history(messages: DataFrame, n: int = 4, length: int = 200) -> DataFrame:
    """Every message with the n before it, as one text."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, length))
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))


def newest_conversations(conversations: DataFrame, n: int, created: str = "created_at") -> DataFrame:
    return conversations.orderBy(F.col(created).desc(), "conv_id").limit(n)


def as_json(messages: DataFrame) -> DataFrame:
    """conv_id, json: the conversation's messages in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m")))), lambda x: x["m"])
    return messages.groupBy("conv_id").agg(F.to_json(F.struct(F.first("conv_id").alias("id"), items.alias("messages"))).alias("json"))


def without(messages: DataFrame, gone: DataFrame) -> DataFrame:
    return messages.join(gone.select("conv_id"), "conv_id", "left_anti")


def snippet(text: Column, length: int = SNIPPET) -> Column:
    """The text, or its beginning up to the last space within ``length`` characters and three dots."""
    return F.when(F.length(text) > length, F.concat(F.regexp_replace(F.substring(text, 1, length), " [^ ]*$", ""), F.lit("..."))).otherwise(text)


def citations(contexts: DataFrame, url: str = "https://example.org/") -> DataFrame:
    """Contexts (query_id, rank, pmid, title, text, score) as citations: index, pmid, title, snippet, score, url."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return contexts.select("query_id", F.row_number().over(w).alias("index"), "pmid", "title", snippet(F.col("text")).alias("snippet"), "score", F.concat(F.lit(url), F.col("pmid").cast("string"), F.lit("/")).alias("url"))


def cited_indices(answer: Column) -> Column:
    """Numbers of the tags in an answer, distinct, as first seen."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(TAG), F.lit(1)), lambda x: F.try_to_number(F.left(x, F.lit(9)), F.lit("999999999")).cast("int")))


def cited(citation_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The citations that an answer (query_id, answer) names; where it names none, the first three with fallback true."""
    named = answers.select("query_id", F.explode(cited_indices(F.col("answer"))).alias("index"))
    matched = citation_rows.join(named, ["query_id", "index"], "left_semi").withColumn("fallback", F.lit(False))
    rest = citation_rows.join(answers.select("query_id"), "query_id", "left_semi").join(matched.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("index") <= 3)
    return matched.unionByName(rest.withColumn("fallback", F.lit(True)))


def coverage(citation_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, total, cited_count, coverage, uncited_high: numbers out of range count as cited, so coverage can exceed 1."""
    named = answers.select("query_id", cited_indices(F.col("answer")).alias("_c"))
    joined = citation_rows.join(named, "query_id")
    high = (F.col("score") > HIGH) & ~F.array_contains("_c", F.col("index"))
    return joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.max(F.size("_c")).alias("cited_count"), F.count_if(high).alias("uncited_high")).withColumn("coverage", F.round(F.col("cited_count") / F.col("total"), 6))


def _one_text(rows: DataFrame, line: Column, order: str, sep: str, name: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("query_id").agg(F.array_join(lines, sep).alias(name))


def reference_list(citation_rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("index"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(". ID: "), F.col("pmid").cast("string"))
    return _one_text(citation_rows, line, "index", "\n", "references")


def prompt_context(contexts: DataFrame, most: int = 10, length: int | None = None) -> DataFrame:
    """query_id, context: "[Document i] (ID) text" of the first contexts."""
    text = F.col("text") if length is None else F.substring("text", 1, length)
    line = F.concat(F.lit("[Document "), F.col("rank"), F.lit("] ("), F.col("pmid").cast("string"), F.lit(") "), text)
    return _one_text(contexts.filter(F.col("rank") <= most), line, "rank", "\n\n", "context")


def sources(citation_rows: DataFrame, most: int = 5) -> DataFrame:
    return citation_rows.filter(F.col("index") <= most).select("query_id", "index", "pmid", "title", F.substring("snippet", 1, SNIPPET).alias("text"), "score")
