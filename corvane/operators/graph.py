"""Entities, relations and neighbourhoods as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import terms as term_tables

# What a term's class is told by; relation patterns in order of priority.
CLASSES = (("DISEASE", ("disease", "syndrome", "disorder", "cancer", "oma")), ("DRUG", ("drug", "therapy", "treatment", "agent")))
WORD = r"([\p{L}\p{N}_]+)"
PATTERNS = (
    (WORD + r"\s+(?:treats?|treatment for)\s+" + WORD, "TREATS"),
    (WORD + r"\s+(?:causes?|leads? to)\s+" + WORD, "CAUSES"),
    (WORD + r"\s+(?:prevents?|prevention of)\s+" + WORD, "PREVENTS"),
    (WORD + r"\s+(?:associated with|related to)\s+" + WORD, "ASSOCIATED_WITH"),
    (WORD + r"\s+(?:diagnoses?|diagnosis of)\s+" + WORD, "DIAGNOSES"),
)
# The default dictionary.
DISEASES = ("diabetes", "cancer", "hypertension", "stroke", "pneumonia", "asthma", "arthritis", "alzheimer", "parkinson", "epilepsy", "tuberculosis", "hepatitis", "cirrhosis", "fibrosis", "carcinoma")
DRUGS = ("insulin", "metformin", "aspirin", "statin", "antibiotic", "chemotherapy", "immunotherapy", "vaccine", "inhibitor", "blocker")
SYMPTOMS = ("pain", "fever", "fatigue", "nausea", "headache", "cough", "inflammation", "swelling", "bleeding", "dysfunction")
DICTIONARY = {"DISEASE": DISEASES, "DRUG": DRUGS, "SYMPTOM": SYMPTOMS}


def term_class(term: Column) -> Column:
    out = F.lit("CONCEPT")
    for kind, parts in reversed(CLASSES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.lower(term).contains(p)
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def entities(docs: DataFrame, dictionary: dict[str, tuple[str, ...]] = DICTIONARY, key: str = "doc_id", text: str = "text", terms: str | None = None) -> DataFrame:
    """key, entity, type: dictionary terms that the text holds, then subject terms by class; distinct on lower-cased entity and type."""
    low = F.lower(F.col(text))
    found = F.array_compact(F.array(*[F.when(low.contains(w), F.struct(F.lit(w).alias("entity"), F.lit(kind).alias("type"))) for kind, ws in dictionary.items() for w in ws]))
    rows = docs.select(key, F.explode(found).alias("e")).select(key, "e.entity", "e.type")
    if terms is not None:
        extra = docs.select(key, F.explode(terms).alias("entity")).select(key, "entity", term_class(F.col("entity")).alias("type"))
        rows = rows.withColumn("_s", F.lit(0)).unionByName(extra.withColumn("_s", F.lit(1)))
        first = Window.partitionBy(key, F.lower("entity"), "type").orderBy("_s", "entity")
        rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_s")
    return rows


def pattern_relations(docs: DataFrame, patterns: tuple = PATTERNS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, source, relation, target, priority: all matches of each pattern in the lower-cased text."""
    low = F.lower(F.col(text))

    def matches(pattern: str, relation: str, priority: int) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("b"))
        return F.transform(pairs, lambda x: F.struct(x["a"].alias("source"), F.lit(relation).alias("relation"), x["b"].alias("target"), F.lit(priority).alias("priority")))

    each = [matches(p, r, i) for i, (p, r) in enumerate(patterns)]
    return docs.select(key, F.explode(F.concat(*each)).alias("r")).select(key, "r.*")


def cooccurrence(found: DataFrame, key: str = "doc_id", left: str = "DRUG", right: str = "DISEASE", relation: str = "TREATS", priority: int = 99) -> DataFrame:
    """Every left entity with every right entity of a document. A document has as many as the dictionary at most."""
    a = found.filter(F.col("type") == left).select(key, F.col("entity").alias("source"))
    b = found.filter(F.col("type") == right).select(key, F.col("entity").alias("target"))
    return a.join(b, key).select(key, "source", F.lit(relation).alias("relation"), "target", F.lit(priority).alias("priority"))


def distinct_relations(relations: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and relation ignoring case, that of first priority."""
    w = Window.partitionBy(key, F.lower("source"), "relation", F.lower("target")).orderBy("priority", "source", "target")
    return relations.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def node_id(entity: Column) -> Column:
    return F.replace(F.lower(entity), F.lit(" "), F.lit("_"))


def nodes(found: DataFrame, seq: str = "doc_id", existing: DataFrame | None = None) -> DataFrame:
    """id, name, type of every entity; the last write (by ``seq``, then type and name) wins, new ones over existing ones."""
    new = found.select(node_id(F.col("entity")).alias("id"), F.struct(F.lit(1).alias("new"), F.col(seq).alias("s"), F.col("type"), F.col("entity").alias("name")).alias("w"))
    if existing is not None:
        new = new.unionByName(existing.select("id", F.struct(F.lit(0).alias("new"), F.lit(None).cast(found.schema[seq].dataType).alias("s"), F.col("type"), F.col("name")).alias("w")))
    return new.groupBy("id").agg(F.max("w").alias("w")).select("id", "w.name", "w.type")


def edges(relations: DataFrame, node_rows: DataFrame, seq: str = "doc_id") -> DataFrame:
    """source, relation, target, seq: the last document wins; no edge without both of its nodes."""
    ids = relations.select(node_id(F.col("source")).alias("source"), "relation", node_id(F.col("target")).alias("target"), F.col(seq).alias("seq"))
    known = node_rows.select("id")
    kept = ids.groupBy("source", "relation", "target").agg(F.max("seq").alias("seq"))
    return kept.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "relation", "target", "seq")


def _both(edge_rows: DataFrame) -> DataFrame:
    e = edge_rows.withColumn("edge", F.struct("source", "relation", "target"))
    return e.select(F.col("source").alias("a"), F.col("target").alias("b"), "edge").unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("b"), "edge"))


def neighbours(start: DataFrame, edge_rows: DataFrame, node_rows: DataFrame, hops: int = 2, limit: int | None = 30) -> DataFrame:
    """start (start id) -> start, id, name, type, distance over 1 to ``hops`` edges, no edge used twice on a path; nearest first.

    An entity may be reached at several distances. With limit, so many rows per start.

    Up to two hops a frontier is its distinct pairs of start and node: two edges of a path are
    the same one only if it comes back to its start, which is no result. A start that has
    ``limit`` near ones goes no farther, so its frontier is cut there, and of a hub the last
    hop takes its first neighbours by id. Farther paths carry the edges they have used.
    """
    plain = hops <= 2
    both = _both(edge_rows)
    if plain:
        both = both.select("a", "b").distinct()
    last = both
    if limit is not None:
        # The last hop needs no more of a hub than its first neighbours by id: so many that the start and the edges used cannot use them up.
        by_id = Window.partitionBy("a").orderBy("b")
        last = both.withColumn("_r", F.dense_rank().over(by_id)).filter(F.col("_r") <= limit + hops).drop("_r")
    paths = start.select(F.col("start"), F.col("start").alias("at"))
    if not plain:
        paths = paths.withColumn("used", F.array().cast("array<struct<source:string,relation:string,target:string>>"))
    out = None
    for d in range(1, hops + 1):
        step = last if d == hops else both
        met = paths.join(step, paths["at"] == step["a"])
        paths = met.select("start", F.col("b").alias("at")).distinct() if plain else met.filter(~F.array_contains("used", F.col("edge"))).select("start", F.col("b").alias("at"), F.array_append("used", F.col("edge")).alias("used"))
        if plain and limit is not None and d < hops:
            # More than ``limit`` (and the start itself) are no longer looked at beyond.
            paths = paths.withColumn("_r", F.row_number().over(Window.partitionBy("start").orderBy("at"))).filter(F.col("_r") <= limit + 1).drop("_r")
        reached = paths.select("start", F.col("at").alias("id"), F.lit(d).alias("distance")).distinct()
        out = reached if out is None else out.unionByName(reached)
        if limit is not None and d < hops:
            # Who has enough near ones already looks no farther.
            full = out.filter("id <> start").groupBy(F.col("start").alias("_s")).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= limit)
            paths = paths.join(full, F.col("start") == F.col("_s"), "left_anti")
    named = out.filter("id <> start").join(node_rows, "id").select("start", "id", "name", "type", "distance")
    if limit is None:
        return named
    w = Window.partitionBy("start").orderBy("distance", "id")
    return named.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def treatments(names: DataFrame, edge_rows: DataFrame, node_rows: DataFrame, limit: int = 20) -> DataFrame:
    """names (name) -> name, id, other: TREATS neighbours in either direction of nodes whose name holds the given one."""
    both = _both(edge_rows.filter("relation = 'TREATS'")).select("a", "b").distinct()
    # Nodes that hold a name are found through the runs of letters of their names' words.
    asked = names.select("name").distinct()
    matched = term_tables.matches(node_rows.select("id", F.col("name").alias("_text")), asked, "id", "_text", "name")
    matched = matched.join(asked, F.lower("name") == F.col("needle")).select("name", "id")
    found = matched.join(both, matched["id"] == both["a"]).select("name", F.col("b").alias("id")).distinct().join(node_rows.select("id", F.col("name").alias("other")), "id")
    w = Window.partitionBy("name").orderBy("id")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select("name", "id", "other")


def counts(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    return node_rows.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edge_rows.agg(F.count(F.lit(1)).alias("edges")))


def build(docs: DataFrame, dictionary: dict[str, tuple[str, ...]] = DICTIONARY, patterns: tuple = PATTERNS, key: str = "doc_id", text: str = "text", terms: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all documents."""
    found = entities(docs, dictionary, key, text, terms)
    relations = distinct_relations(pattern_relations(docs, patterns, key, text).unionByName(cooccurrence(found, key)), key)
    vertex = nodes(found, key)
    return vertex, edges(relations, vertex, key)


def retrieve(queries: DataFrame, edge_rows: DataFrame, node_rows: DataFrame, k: int, dictionary: dict[str, tuple[str, ...]] = DICTIONARY) -> DataFrame:
    """query_id, n, id, name: entities near those of the query (two hops), then treatments of its diseases; first seen first, k of them."""
    asked = entities(queries, dictionary, "query_id", "query")
    near = neighbours(asked.select(node_id(F.col("entity")).alias("start")).distinct(), edge_rows, node_rows)
    by_query = asked.withColumn("start", node_id(F.col("entity")))
    first = by_query.join(near, "start").select("query_id", F.lit(0).alias("o"), F.col("distance").alias("p"), "id", "name")
    ill = asked.filter("type = 'DISEASE'").select("query_id", F.col("entity").alias("name"))
    cure = ill.join(treatments(ill, edge_rows, node_rows), "name").select("query_id", F.lit(1).alias("o"), F.lit(0).alias("p"), "id", F.col("other").alias("name"))
    seen = Window.partitionBy("query_id", "id").orderBy("o", "p")
    order = Window.partitionBy("query_id").orderBy("o", "p", "id")
    return first.unionByName(cure).withColumn("_s", F.row_number().over(seen)).filter("_s = 1").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).select("query_id", "n", "id", "name")
