"""Queries over conversations, question texts, entities, logs and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dialog, fusion, graph, incremental, logs, querytext
from ..sources import tables as io
from .corpus import BM25, bm25_hits
from .tables import articles, query, questions, table


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))


M = "m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM m)"
ROLE = "CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END"


@query(f"WITH {M} SELECT conv_id, turn, role FROM r WHERE n <= 4")
def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.last_turns(_messages(spark, sf), 2).select("conv_id", "turn", "role")


@query(f"WITH {M} SELECT conv_id, string_agg({ROLE} || ': ' || substr(text, 1, 100), chr(10) ORDER BY turn) AS summary FROM r WHERE n <= 4 GROUP BY conv_id")
def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.summaries(_messages(spark, sf))


@query(f"""WITH {M}, h AS (SELECT conv_id, string_agg({ROLE} || ': ' || substr(text, 1, 200), chr(10) ORDER BY turn) AS h FROM r WHERE n <= 4 GROUP BY conv_id)
SELECT item_id AS conv_id, b.text AS question, CASE WHEN h IS NULL THEN b.text ELSE h || chr(10) || 'User: ' || b.text END AS prompt FROM benchmark b LEFT JOIN h ON h.conv_id = b.item_id""")
def history_question(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf).select(F.col("query_id").alias("conv_id"), F.col("query").alias("question"))
    return dialog.questions_with_history(q, _messages(spark, sf))


@query("""WITH m AS (SELECT conv_id, turn, role || ': ' || substr(coalesce(text, ''), 1, 200) AS line FROM conversations)
SELECT conv_id, turn, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history FROM m""")
def rolling_history(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.rolling_history(_messages(spark, sf)).select("conv_id", "turn", "history")


@query("SELECT conv_id, count(*) AS created_at FROM conversations GROUP BY conv_id ORDER BY created_at DESC, conv_id LIMIT 50")
def newest_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = _messages(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("created_at"))
    return dialog.newest_conversations(c, 50)


@query("""SELECT conv_id, '{"id":' || conv_id || ',"messages":[' || string_agg('{"role":' || to_json(role)::VARCHAR || ',"n":' || length(coalesce(text, '')) || '}', ',' ORDER BY turn) || ']}' AS json FROM conversations GROUP BY conv_id""")
def conversation_json(spark: SparkSession, sf: str) -> DataFrame:
    """Exports with each text's length in place of the text: engines differ in how they escape."""
    exported = dialog.as_json(_messages(spark, sf).withColumn("text", F.length("text")))
    return exported.select("conv_id", F.regexp_replace("json", '"content":', '"n":').alias("json"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def cleared_conversations(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf)
    return dialog.without(m, m.filter("role = 'system'").select("conv_id").distinct()).select("conv_id", "turn")


# Citations: the questions' BM25 hits are the contexts; the answers cite some of them.
ANSWERS = "an AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'None is named.' ELSE 'See [Document ' || (item_id % 5 + 1) || '] and [' || (item_id % 4 + 1) || '], again [document ' || (item_id % 5 + 1) || '] and [17].' END AS answer FROM benchmark)"
CONTEXTS = f"{BM25}, ct AS (SELECT query_id, rank, bm.doc_id AS pmid, split_part(coalesce(d.text, ''), chr(10), 1) AS title, coalesce(d.text, '') AS text, score FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 10), {ANSWERS}"
CITED = "ci AS (SELECT query_id, answer, regexp_extract_all(answer, '(?i)\\[(?:Document\\s*)?(\\d+)\\]', 1) AS raw FROM an), nm AS (SELECT DISTINCT query_id, unnest(raw)::INT AS idx FROM ci)"


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("query_id")
    n = lambda by: (i % by + 1).cast("string")
    text = F.concat(F.lit("See [Document "), n(5), F.lit("] and ["), n(4), F.lit("], again [document "), n(5), F.lit("] and [17]."))
    return questions(spark, sf).select("query_id", F.when(i % 3 == 0, "None is named.").otherwise(text).alias("answer"))


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    hits = bm25_hits(spark, sf, 10).withColumnRenamed("doc_id", "d")
    return hits.join(articles(spark, sf), F.col("d") == F.col("doc_id")).select("query_id", "rank", F.col("doc_id").alias("pmid"), "title", F.col("abstract").alias("text"), "score")


@query(f"WITH {ANSWERS}, {CITED}, o AS (SELECT query_id, unnest(raw)::INT AS idx, generate_subscripts(raw, 1) AS p FROM ci), f AS (SELECT query_id, idx, min(p) AS p FROM o GROUP BY ALL) SELECT an.query_id, coalesce(string_agg(idx::VARCHAR, ',' ORDER BY p), '') AS cited FROM an LEFT JOIN f USING (query_id) GROUP BY an.query_id")
def cited_indices(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.transform(dialog.cited_indices(F.col("answer")), lambda x: x.cast("string"))
    return _answers(spark, sf).select("query_id", F.array_join(cited, ",").alias("cited"))


@query(f"""WITH {CONTEXTS} SELECT query_id, rank AS index, pmid, title, CASE WHEN length(text) > 200 THEN regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '...' ELSE text END AS snippet, score, 'https://example.org/' || pmid || '/' AS url FROM ct""")
def citation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.citations(_contexts(spark, sf))


@query(f"""WITH {CONTEXTS}, {CITED}, h AS (SELECT ct.query_id, ct.rank, ct.pmid FROM ct JOIN nm ON nm.query_id = ct.query_id AND nm.idx = ct.rank)
SELECT query_id, rank AS index, pmid, false AS fallback FROM h UNION ALL SELECT query_id, rank, pmid, true FROM ct WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM h)""")
def citation_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.cited(dialog.citations(_contexts(spark, sf)), _answers(spark, sf)).select("query_id", "index", "pmid", "fallback")


@query(f"""WITH {CONTEXTS}, {CITED}, c AS (SELECT query_id, count(*) AS cited FROM nm GROUP BY query_id)
SELECT ct.query_id, count(*) AS total, coalesce(max(cited), 0)::INT AS cited_count, count(*) FILTER (score > 0.7 AND idx IS NULL) AS uncited_high, round(coalesce(max(cited), 0)::DOUBLE / count(*), 6) AS coverage
FROM ct LEFT JOIN c ON c.query_id = ct.query_id LEFT JOIN nm ON nm.query_id = ct.query_id AND nm.idx = ct.rank GROUP BY ct.query_id""")
def citation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.coverage(dialog.citations(_contexts(spark, sf)), _answers(spark, sf))


@query(f"WITH {CONTEXTS} SELECT query_id, string_agg('[' || rank || '] ' || title || '. ID: ' || pmid, chr(10) ORDER BY rank) AS references FROM ct GROUP BY query_id")
def reference_list(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.reference_list(dialog.citations(_contexts(spark, sf)))


@query(f"WITH {CONTEXTS} SELECT query_id, md5(string_agg('[Document ' || rank || '] (' || pmid || ') ' || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM ct GROUP BY query_id")
def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.prompt_context(_contexts(spark, sf)).select("query_id", F.md5("context").alias("context"))


@query(f"""WITH {CONTEXTS} SELECT query_id, rank AS index, pmid, title, substr(CASE WHEN length(text) > 200 THEN regexp_replace(substr(text, 1, 200), ' [^ ]*$', '') || '...' ELSE text END, 1, 200) AS text, score FROM ct WHERE rank <= 5""")
def source_list(spark: SparkSession, sf: str) -> DataFrame:
    return dialog.sources(dialog.citations(_contexts(spark, sf)))


# Question texts. The dictionary below is of words that the driver's prose has.
WORDS = {"THE": "the very", "DE": "de la part de", "IN": "within", "DER": "derselbe"}
SYN = (("the", ("that", "this", "those")), ("der", ("dieser", "jener")), ("que", ("lequel", "quoi")), ("de", ("du", "des")))


def _q(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf)


EXPANDED = "array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: CASE upper(regexp_replace(w, '^[.,?!;:]+|[.,?!;:]+$', '', 'g')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + " ELSE w END), ' ')"


@query(f"SELECT item_id AS query_id, {EXPANDED} AS expanded FROM benchmark")
def expand_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).select("query_id", querytext.expand_abbreviations(F.col("query"), WORDS).alias("expanded"))


SYN_CASE = "CASE " + " ".join(f"WHEN contains(lower(text), '{t}') THEN {{0}}" .format("[text, " + ", ".join(f"regexp_replace(text, '{t}', '{s}', 'gi')" for s in syns[:3]) + "]") for t, syns in SYN) + " ELSE [text] END"


@query(f"WITH v AS (SELECT item_id, unnest({SYN_CASE}) AS t, unnest(range(10)) AS p FROM benchmark), f AS (SELECT item_id, t, min(p) AS p FROM v WHERE t IS NOT NULL GROUP BY ALL) SELECT item_id AS query_id, count(*)::INT AS n, md5(string_agg(t, '|' ORDER BY p)) AS h FROM f GROUP BY item_id")
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    v = querytext.variants(F.col("query"), 3, SYN)
    return _q(spark, sf).select("query_id", F.size(v).alias("n"), F.md5(F.array_join(v, "|")).alias("h"))


EXTRA = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') AND NOT contains(lower(text), '{s}') THEN '{s}' END" for t, syns in SYN for s in syns[:2]) + "], lambda x: x IS NOT NULL)[1:3]"


@query(f"WITH e AS (SELECT item_id, {EXPANDED} AS base, {EXTRA} AS extra FROM benchmark) SELECT item_id AS query_id, CASE WHEN len(extra) > 0 THEN base || ' (' || array_to_string(extra, ' ') || ')' ELSE base END AS enhanced FROM e")
def enhanced_query(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).select("query_id", querytext.enhanced(F.col("query"), SYN, WORDS).alias("enhanced"))


@query("WITH k AS (SELECT item_id, list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t, _ in SYN) + "], lambda x: x IS NOT NULL) AS hits, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 3) AS rest FROM benchmark) SELECT item_id AS query_id, array_to_string(CASE WHEN len(hits) > 0 THEN hits ELSE rest END, '|') AS terms FROM k")
def key_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).select("query_id", F.array_join(querytext.key_terms(F.col("query"), SYN), "|").alias("terms"))


@query("""WITH w AS (SELECT item_id, lower(regexp_replace(u, '[^A-Za-z]', '', 'g')) AS w FROM benchmark, unnest(regexp_split_to_array(text, '\\s+')) AS t(u))
SELECT DISTINCT w AS term, CASE w WHEN 'the' THEN 'that,this,those' WHEN 'that' THEN 'that,this,those' WHEN 'this' THEN 'that,this,those' WHEN 'those' THEN 'that,this,those' WHEN 'der' THEN 'dieser,jener' WHEN 'dieser' THEN 'dieser,jener' WHEN 'jener' THEN 'dieser,jener'
 WHEN 'que' THEN 'lequel,quoi' WHEN 'lequel' THEN 'lequel,quoi' WHEN 'quoi' THEN 'lequel,quoi' WHEN 'de' THEN 'du,des' WHEN 'du' THEN 'du,des' WHEN 'des' THEN 'du,des' ELSE '' END AS synonyms FROM w""")
def term_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    w = _q(spark, sf).select(F.explode(F.split("query", r"\s+")).alias("u")).select(F.lower(F.regexp_replace("u", "[^A-Za-z]", "")).alias("term")).distinct()
    return w.select("term", F.array_join(querytext.synonyms_of(F.col("term"), SYN), ",").alias("synonyms"))


@query("""WITH v AS (SELECT item_id // 4 AS query_id, item_id % 4 AS list_no, unnest(regexp_split_to_array(text, '\\s+')) AS text, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 AS pos FROM benchmark),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY list_no, pos) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY list_no, pos)::INT AS n, text FROM f QUALIFY n <= 20""")
def merged_variants(spark: SparkSession, sf: str) -> DataFrame:
    q = _q(spark, sf).select(F.floor(F.col("query_id") / 4).alias("query_id"), (F.col("query_id") % 4).alias("list_no"), F.posexplode(F.split("query", r"\s+")).alias("pos", "text"))
    return querytext.merge_variants(q, 20)


@query("""WITH q AS (SELECT item_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, (contains(lower(text), 'tion') OR contains(lower(text), 'der')) AS known,
 (ends_with(trim(text), '?') OR starts_with(text, 'what') OR starts_with(text, 'how') OR starts_with(text, 'why') OR starts_with(text, 'when') OR starts_with(text, 'which')) AS ask FROM benchmark)
SELECT item_id AS query_id, CASE WHEN n <= 3 THEN 0.35 WHEN ask AND known THEN 0.35 ELSE 0.4 END::DOUBLE AS vector, CASE WHEN n <= 3 THEN 0.25 WHEN ask AND known THEN 0.4 ELSE 0.35 END::DOUBLE AS expanded, CASE WHEN n <= 3 THEN 0.4 WHEN ask AND known THEN 0.25 ELSE 0.25 END::DOUBLE AS text FROM q""")
def adaptive_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).select("query_id", fusion.adaptive_weights(F.col("query"), ("tion", "der")).alias("w")).select("query_id", "w.*")


# Graph: a dictionary and patterns of words that the driver's prose has.
NAMES = {"DISEASE": ("license", "nicht", "avec", "with"), "DRUG": ("version", "sich", "pour", "from"), "SYMPTOM": ("password", "para", "that")}
W = r"([\p{L}\p{N}_]+)"
PATTERNS = ((W + r"\s+(?:of the|de la)\s+" + W, "OF"), (W + r"\s+(?:is|are)\s+" + W, "IS"), (W + r"\s+(?:und|et|and)\s+" + W, "WITH"))
ENTITIES = "en AS (" + " UNION ALL ".join(f"SELECT doc_id, '{w}' AS entity, '{kind}' AS type FROM documents WHERE contains(lower(text), '{w}')" for kind, ws in NAMES.items() for w in ws) + ")"
RELATIONS = "pr AS (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{p}', 1)) AS source, '{r}' AS relation, unnest(regexp_extract_all(lower(text), '{p}', 2)) AS target, {i} AS priority FROM documents" for i, (p, r) in enumerate(PATTERNS)) + ")"
CO = "co AS (SELECT a.doc_id, a.entity AS source, 'TREATS' AS relation, b.entity AS target, 99 AS priority FROM en a JOIN en b ON a.doc_id = b.doc_id AND a.type = 'DRUG' AND b.type = 'DISEASE')"
NODES = "nd AS (SELECT DISTINCT replace(entity, ' ', '_') AS id, entity AS name, type FROM en)"
EDGES = "eg AS (SELECT source, relation, target, max(doc_id) AS seq FROM (SELECT * FROM pr UNION ALL SELECT * FROM co) WHERE source IN (SELECT id FROM nd) AND target IN (SELECT id FROM nd) GROUP BY ALL)"
GRAPH = f"{ENTITIES}, {RELATIONS}, {CO}, {NODES}, {EDGES}, bo AS (SELECT source AS a, target AS b, source || '|' || relation || '|' || target AS e FROM eg UNION ALL SELECT target, source, source || '|' || relation || '|' || target FROM eg)"


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph.build(table(spark, sf, "documents"), NAMES, PATTERNS)
    return io.cut(nodes), io.cut(edges)


@query(f"WITH {ENTITIES} SELECT doc_id, entity, type FROM en")
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.entities(table(spark, sf, "documents"), NAMES)


@query(f"WITH {RELATIONS} SELECT doc_id, source, relation, target, priority FROM pr")
def pattern_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pattern_relations(table(spark, sf, "documents"), PATTERNS)


@query(f"WITH {ENTITIES}, {CO} SELECT doc_id, source, target FROM co")
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cooccurrence(graph.entities(table(spark, sf, "documents"), NAMES)).select("doc_id", "source", "target")


@query(f"WITH {RELATIONS}, d AS (SELECT DISTINCT doc_id, source, relation, target FROM pr) SELECT * FROM d")
def distinct_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.distinct_relations(graph.pattern_relations(table(spark, sf, "documents"), PATTERNS)).select("doc_id", "source", "relation", "target")


@query(f"WITH {GRAPH} SELECT id, name, type FROM nd")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[0]


@query(f"WITH {GRAPH} SELECT source, relation, target, seq FROM eg")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[1]


@query(f"""WITH {GRAPH}, p AS (SELECT a AS start, b AS id, 1 AS distance FROM bo UNION SELECT x.a, y.b, 2 FROM bo x JOIN bo y ON x.b = y.a AND x.e <> y.e)
SELECT start, p.id, name, type, distance FROM p JOIN nd ON nd.id = p.id WHERE p.id <> start QUALIFY row_number() OVER (PARTITION BY start ORDER BY distance, p.id) <= 30""")
def neighbours_2hop(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return graph.neighbours(nodes.select(F.col("id").alias("start")), edges, nodes)


@query(f"""WITH {GRAPH}, t AS (SELECT DISTINCT nd.name, x.b AS id FROM nd JOIN bo x ON x.a = nd.id WHERE x.e LIKE '%|TREATS|%' AND nd.type = 'DISEASE')
SELECT t.name, t.id, nd.name AS other FROM t JOIN nd ON nd.id = t.id QUALIFY row_number() OVER (PARTITION BY t.name ORDER BY t.id) <= 20""")
def treatments(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return graph.treatments(nodes.filter("type = 'DISEASE'").select("name"), edges, nodes)


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM eg) AS edges")
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.counts(*_graph(spark, sf))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(lower(title), 'disease|syndrome|disorder|cancer|oma') THEN 'DISEASE' WHEN regexp_matches(lower(title), 'drug|therapy|treatment|agent') THEN 'DRUG' ELSE 'CONCEPT' END AS class FROM (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents)")
def term_class(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("doc_id", graph.term_class(F.col("title")).alias("class"))


ASKED = "ae AS (" + " UNION ALL ".join(f"SELECT item_id AS query_id, '{w}' AS entity, '{kind}' AS type FROM benchmark WHERE contains(lower(text), '{w}')" for kind, ws in NAMES.items() for w in ws) + ")"


@query(f"""WITH {GRAPH}, {ASKED}, p AS (SELECT a AS start, b AS id, 1 AS distance FROM bo UNION SELECT x.a, y.b, 2 FROM bo x JOIN bo y ON x.b = y.a AND x.e <> y.e),
nr AS (SELECT start, p.id, name, distance FROM p JOIN nd ON nd.id = p.id WHERE p.id <> start QUALIFY row_number() OVER (PARTITION BY start ORDER BY distance, p.id) <= 30),
t AS (SELECT DISTINCT nd.name, x.b AS id FROM nd JOIN bo x ON x.a = nd.id WHERE x.e LIKE '%|TREATS|%'), tr AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) <= 20),
al AS (SELECT query_id, 0 AS o, distance AS d, nr.id, nr.name FROM ae JOIN nr ON nr.start = replace(ae.entity, ' ', '_') UNION ALL SELECT query_id, 1, 0, tr.id, nd.name FROM ae JOIN tr ON tr.name = ae.entity JOIN nd ON nd.id = tr.id WHERE ae.type = 'DISEASE'),
f AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY o, d) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o, d, id)::INT AS n, id, name FROM f QUALIFY n <= 10""")
def graph_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return graph.retrieve(questions(spark, sf), edges, nodes, 10, NAMES)


# Logs: events as query and latency logs.
@query("SELECT count(*) AS queries, round(avg(user_id), 6) AS mean_results, round(avg(value / 500), 6) AS mean_recall, round(avg(value), 6) AS mean_latency FROM events WHERE ts >= TIMESTAMP '2024-01-05' HAVING count(*) > 0")
def query_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter(F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))
    return logs.query_stats(e, F.col("value") / 500, F.col("value"), "user_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return logs.latest(table(spark, sf, "events"), "ts", "event_id").select("event_id", "event_type")


@query("SELECT count(*) AS count, round(sum(strlen(coalesce(text, ''))) / 1048576.0, 6)::DOUBLE AS size_mb FROM documents")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return logs.collection_stats(table(spark, sf, "documents"), F.octet_length(F.coalesce("text", F.lit(""))))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(1000 / avg(value), 6) AS qps FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return logs.latency_summary(table(spark, sf, "events"), "value", ["event_type"])


@query("SELECT source, round(avg(length(text)), 6) AS mean_len, max(length(text))::INT AS max_len, min(length(text))::INT AS min_len FROM documents GROUP BY source")
def length_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return logs.length_by_group(table(spark, sf, "documents"), "text", "source")


@query("SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean_len FROM documents GROUP BY source")
def count_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return logs.count_by_group(table(spark, sf, "documents"), "text", "source")


@query("WITH b AS (SELECT unnest([0.1, 1.0, 10.0, 50.0, 100.0, 250.0])::DOUBLE AS le) SELECT event_type, (SELECT count(value) FROM events x WHERE x.event_type = e.event_type) AS total, (SELECT round(sum(value), 6) FROM events x WHERE x.event_type = e.event_type) AS sum, le, count(*) FILTER (value <= le) AS n FROM events e, b GROUP BY event_type, le")
def latency_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return logs.buckets(table(spark, sf, "events"), "value", ["event_type"], (0.1, 1.0, 10.0, 50.0, 100.0, 250.0))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def label_counters(spark: SparkSession, sf: str) -> DataFrame:
    return logs.counters(table(spark, sf, "events"), ["event_type", "user_id"])


@query("SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return logs.gauges(table(spark, sf, "events"), "value", "ts", ["user_id"], "event_id")


@query("SELECT event_type, count(*) FILTER (value < 50) AS hits, count(*) FILTER (value >= 50) AS misses, round(100.0 * count(*) FILTER (value < 50) / count(*), 2)::DOUBLE AS hit_rate FROM events GROUP BY event_type")
def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return logs.hit_rate(table(spark, sf, "events"), F.col("value") < 50, ["event_type"])


@query("SELECT source, count(*) AS n, sum(strlen(coalesce(text, '')))::BIGINT AS bytes, sum(strlen(coalesce(text, ''))) >= 104857.6 AS complete FROM documents GROUP BY source")
def topic_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return logs.topic_bytes(table(spark, sf, "documents"), "source", F.octet_length(F.coalesce("text", F.lit(""))), target_mb=0.1)


@query("""WITH n AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS b, strlen(coalesce(text, '')) AS s FROM documents),
g AS (SELECT source, b, sum(s) AS s FROM n GROUP BY ALL), c AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY source ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT doc_id, n.source FROM n JOIN c ON c.source IS NOT DISTINCT FROM n.source AND c.b = n.b WHERE before < 50000""")
def topic_quota(spark: SparkSession, sf: str) -> DataFrame:
    return logs.topic_quota(table(spark, sf, "documents"), "source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))), 50_000, 10).select("doc_id", "source")


@query("SELECT event_type, count(*) AS checks, count(*) FILTER (value < 300) AS passed, count(*) = count(*) FILTER (value < 300) AS ok FROM events GROUP BY event_type")
def component_summary(spark: SparkSession, sf: str) -> DataFrame:
    return logs.pass_summary(table(spark, sf, "events"), "event_type", F.col("value") < 300)


@query("WITH r AS (SELECT event_type AS method, count(*) AS n, sum(value) AS seconds FROM events GROUP BY event_type), t AS (SELECT method, n, round(seconds, 4) AS seconds, round(n / seconds, 6) AS rate FROM r) SELECT *, round(rate / min(rate) OVER (), 6) AS ratio FROM t")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("seconds"))
    return logs.throughput(r).withColumn("seconds", F.round("seconds", 4))


@query("SELECT ts, 'q' || user_id AS query, 3 AS num_results, event_type AS metrics, '0,1,2' AS result_ids FROM events WHERE event_type = 'click'")
def query_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type = 'click'")
    rows = io.query_log(e.select(F.col("ts").alias("timestamp"), F.concat(F.lit("q"), "user_id").alias("query"), F.col("event_type").alias("metrics"), F.array(F.lit("0"), F.lit("1"), F.lit("2")).alias("ids")))
    return rows.select(F.col("timestamp").alias("ts"), "query", "num_results", "metrics", F.array_join("result_ids", ",").alias("result_ids"))


# Updates.
@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_rows(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.unprocessed(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE length(text) > 200)")
def supplement_rows(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "documents").filter(F.length("text") > 200).select(F.col("doc_id").alias("item_id"))
    return io.supplement(table(spark, sf, "benchmark").select("item_id"), held, "item_id")


@query("""WITH a AS (SELECT doc_id::VARCHAR AS path, md5(text) AS m FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS o FROM documents WHERE doc_id % 3 <> 0)
SELECT path, CASE WHEN o IS NULL THEN 'new' WHEN m IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE m IS DISTINCT FROM o""")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("mark"))
    before = d.filter("doc_id % 3 <> 0").withColumn("mark", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("mark")))
    return incremental.diff(d.filter("doc_id % 5 <> 0"), before)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def store_capped(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.capped(table(spark, sf, "events"), "ts", "event_id", 1000).select("event_id")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 7200 SECOND > TIMESTAMP '2024-01-20'")
def store_alive(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.alive(e, F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT user_id FROM events GROUP BY user_id ORDER BY max(event_id) DESC LIMIT 100")
def log_retention(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    return incremental.trim_log(done, "last", 100, 100).select("user_id")
