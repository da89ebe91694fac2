"""Queries that write the driver's tables to stores in the shared folder and read them back: sources, sinks, resumed and repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import paragraphs, truncated
from ..operators import chunk, evaluate, incremental, rerank, vectors
from ..sources import tables as io
from ..sources import json_elements, xml
from ..streaming import stages
from .corpus import BM25, OVERLAP, ROWS, SLIDING, STRIP, SUMMARY, TOKENS, A, _chunks, _measures, bm25_hits, knn_hits, label_judgments
from .tables import articles, query, questions, table

PLAIN = "regexp_replace({0}, '[^A-Za-z0-9.,]+', ' ', 'g')"


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf)
    return a.select("pmid", "title", "abstract", "topic", F.array(F.col("topic")).alias("keywords"), F.floor(F.col("doc_id") / 1000).alias("_bucket"))


def _arrays(df: DataFrame, folder: str) -> None:
    """Rows as JSON arrays, one a file: those of a bucket of a thousand ids."""
    rows = df.groupBy("_bucket").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != "_bucket"])))).alias("value"))
    rows.repartition("_bucket").write.partitionBy("_bucket").text(folder)


SHORT = "SELECT pmid, md5(title) AS title, md5(abstract) AS abstract, topic FROM a"


def _short(df: DataFrame) -> DataFrame:
    return df.select("pmid", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), "topic")


@query(f"WITH {A} {SHORT}")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = io.new_folder(spark, "json-lines")
    _articles(spark, sf).drop("_bucket").write.json(out)
    return _short(io.read_articles(spark, out))


@query(f"WITH {A} {SHORT}")
def json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays on one line each, read as such and as whole files."""
    out = io.new_folder(spark, "json-array")
    _arrays(_articles(spark, sf), out)
    by_line, whole = io.read_articles(spark, out), io.read_articles(spark, out, multi_line=True)
    return _short(by_line).intersect(_short(whole))


@query(f"WITH {A} {SHORT}")
def json_array_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same arrays, each read by as many tasks as it has blocks."""
    out = io.new_folder(spark, "json-array")
    _arrays(_articles(spark, sf), out)
    return _short(json_elements.read_array(spark, out, io.ARTICLE))


@query(f"WITH {A} SELECT pmid, md5(abstract) AS abstract, topic FROM a WHERE topic IS NOT NULL")
def topic_files(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of even ids have no topic of their own and take their file's."""
    out = io.new_folder(spark, "topic-files")
    io.write_topic_files(_articles(spark, sf).drop("_bucket").withColumn("_topic", F.col("topic")).withColumn("topic", F.when(F.col("pmid").cast("bigint") % 2 == 1, F.col("topic"))), out, "_topic")
    return io.read_topic_files(spark, f"{out}/*.json").select("pmid", F.md5("abstract").alias("abstract"), "topic")


@query("SELECT DISTINCT 'checkpoint_' || source || '.data.json' AS name, true AS filled FROM documents WHERE source IS NOT NULL")
def listed_objects(spark: SparkSession, sf: str) -> DataFrame:
    out = io.new_folder(spark, "objects")
    io.write_topic_files(_articles(spark, sf).drop("_bucket"), out)
    listed = io.list_objects(spark, out, "checkpoint_")
    return listed.select("name", (F.col("size_mb") > 0).alias("filled"))


XML_TEXT = f"trim({PLAIN.format('abstract')})"


def _xml_files(spark: SparkSession, sf: str) -> str:
    out = io.new_folder(spark, "xml")
    a = articles(spark, sf)
    plain = lambda c: F.trim(F.regexp_replace(c, "[^A-Za-z0-9.,]+", " "))
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    author = tag("AuthorList", F.concat(*[tag("Author", F.concat(tag("LastName", F.concat(F.lit("L"), F.col("pmid"))), tag("ForeName", F.lit(f"F{i}")))) for i in range(6)]))
    article = tag("Article", F.concat(tag("ArticleTitle", F.concat(F.lit("T"), F.col("pmid"))), tag("Abstract", tag("AbstractText", plain(F.col("abstract")))), author, tag("Journal", tag("JournalIssue", tag("PubDate", F.concat(tag("Year", F.lit("2020")), tag("Month", F.lit("Jan"))))))))
    citation = tag("PubmedArticle", tag("MedlineCitation", F.concat(tag("PMID", F.col("pmid")), article)))
    # A file is one document: the records of a thousand ids within a root.
    rows = a.select(F.floor(F.col("doc_id") / 1000).alias("_bucket"), citation.alias("c")).groupBy("_bucket").agg(F.concat(F.lit("<Set>"), F.array_join(F.collect_list("c"), "\n"), F.lit("</Set>")).alias("value"))
    rows.repartition("_bucket").write.partitionBy("_bucket").text(out)
    return out


@query(f"WITH {A} SELECT pmid, md5({XML_TEXT}) AS abstract, 'F0 L' || pmid || '|F1 L' || pmid || '|F2 L' || pmid || '|F3 L' || pmid || '|F4 L' || pmid AS authors, '2020-Jan' AS pub_date FROM a WHERE length({XML_TEXT}) >= 100")
def xml_articles(spark: SparkSession, sf: str) -> DataFrame:
    read = xml.read_articles(spark, _xml_files(spark, sf), "all")
    return read.select("pmid", F.md5("abstract").alias("abstract"), F.array_join("authors", "|").alias("authors"), "pub_date")


@query(f"WITH {A} SELECT pmid, 'T' || pmid AS title, md5('T' || pmid || chr(10) || chr(10) || {XML_TEXT}) AS full_text, 'all' AS topic FROM a WHERE length({XML_TEXT}) >= 1")
def xml_abstracts(spark: SparkSession, sf: str) -> DataFrame:
    return xml.read_abstracts(spark, _xml_files(spark, sf), "all").select("pmid", "title", F.md5("full_text").alias("full_text"), "topic")


@query("SELECT doc_id, source, n_chars FROM documents")
def parquet_columns(spark: SparkSession, sf: str) -> DataFrame:
    out = io.new_folder(spark, "parquet")
    io.write_parquet(table(spark, sf, "documents"), out)
    return io.read_columns(spark, out, ["doc_id", "source", "n_chars"])


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 300")
def json_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = io.new_folder(spark, "sample")
    io.write_sample(table(spark, sf, "documents").select("doc_id", "n_chars"), out, "doc_id", 300)
    return spark.read.schema("doc_id bigint, n_chars bigint").json(out)


@query("SELECT item_id::VARCHAR AS query_id, (item_id * 2 + i)::VARCHAR AS doc_id, (i + 1)::INT AS grade FROM benchmark, range(3) AS r(i)")
def judged_set(spark: SparkSession, sf: str) -> DataFrame:
    out = io.new_folder(spark, "judged")
    q = questions(spark, sf)
    ids = F.array(*[(F.col("query_id") * 2 + i).cast("string") for i in range(3)])
    rows = q.select(F.floor(F.col("query_id") / 1000).alias("_bucket"), F.col("query_id").cast("string").alias("id"), "query", ids.alias("relevant_doc_ids"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("relevance_grades"))
    _arrays(rows, out)
    return io.judgments(io.read_judged(spark, out))


@query(f"WITH {A} SELECT pmid AS key, md5(title) AS title, md5(abstract) AS abstract FROM a")
def topic_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Articles as keyed JSON messages, stored and read as a topic's values are."""
    out = io.new_folder(spark, "messages")
    stages.as_messages(_articles(spark, sf).select("pmid", "title", "abstract", "topic")).write.parquet(out)
    stored = spark.read.parquet(out).withColumn("v", F.from_json("value", io.MESSAGE))
    return stored.select("key", F.md5("v.title").alias("title"), F.md5("v.abstract").alias("abstract"))


@query("SELECT doc_id, d AS created_at FROM documents, (VALUES (TIMESTAMP '2024-01-01'), (TIMESTAMP '2024-01-02')) AS t(d)")
def stamped_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = io.new_folder(spark, "stamped")
    rows = table(spark, sf, "documents").select("doc_id")
    for day in ("2024-01-01", "2024-01-02"):
        io.append_stamped(rows, out, F.lit(day).cast("timestamp_ntz"))
    return spark.read.parquet(out).select("doc_id", "created_at")


@query(f"WITH {_measures()} SELECT model, metric, mean FROM ({SUMMARY}), (VALUES ('first'), ('second')) AS t(model)")
def evaluation_history(spark: SparkSession, sf: str) -> DataFrame:
    out = io.new_folder(spark, "evaluations")
    rows = io.stored(evaluate.summary(evaluate.per_query(knn_hits(spark, sf, sampled=True), label_judgments(spark, sf)), "knn"), "summary")
    for model in ("first", "second"):
        io.append_evaluation(rows, out, model, F.lit("2024-01-01").cast("timestamp_ntz"))
    return spark.read.parquet(out).select("model", "metric", "mean")


@query(f"WITH {SLIDING}, {ROWS} SELECT doc_id || '_' || chunk_no AS chunk_id, md5(substr(c, 1, 200)) AS chunk_text, left(c, 1) AS first FROM c")
def vector_store_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk rows cut to what the store takes, joined to their vectors by id."""
    c = _chunks(spark, sf, chunk.sliding)
    made = c.select("chunk_id", F.left("chunk_text", F.lit(1)).alias("first"))
    rows = io.attach_vectors(io.vector_rows(c.select("chunk_id", "chunk_text"), 200), made)
    return rows.select("chunk_id", F.md5("chunk_text").alias("chunk_text"), "first")


@query("SELECT doc_id, md5(substr(coalesce(text, ''), 1, 500)) AS h FROM documents")
def truncated_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(truncated(F.coalesce("text", F.lit("")), 500)).alias("h"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score FROM bm WHERE rank <= 20 AND score >= 5")
def least_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.at_least(bm25_hits(spark, sf, 20), 5.0).select("query_id", "doc_id", "score")


@query(rf"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents) SELECT doc_id, len(ps)::INT AS n, md5(array_to_string(ps, '|')) AS h FROM p")
def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The driver's texts have no blank lines: one is put after every full stop."""
    p = paragraphs(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n \n")))
    return table(spark, sf, "documents").select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("h"))


@query(f"WITH {SLIDING.replace('462', '256').replace('512', '256').replace('>= 100) AS cs', '>= 20) AS cs').replace('WHERE length(text) >= 100', 'WHERE length(text) >= 20')}, {ROWS} SELECT doc_id || '_' || chunk_no AS chunk_id, md5(c) AS h FROM c")
def chunk_sized(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, lambda t: chunk.sliding(t, 256, 0, 20)).select("chunk_id", F.md5("chunk_text").alias("h"))


HASHED = f"""t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS t FROM documents), c AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS i, count(*)::DOUBLE AS n FROM t GROUP BY ALL)"""


@query(f"WITH {HASHED}, m AS (SELECT doc_id, round(max(n) / sqrt(sum(n * n)), 6) AS largest FROM c GROUP BY doc_id) SELECT d.doc_id, m.largest FROM documents d LEFT JOIN m USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def encode_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents have a stored vector; the rest is encoded."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = vectors.encode_missing(docs, table(spark, sf, "labels"), "doc_id", "text", lambda d: vectors.hashed_terms(d, "doc_id", "text"))
    return made.select("doc_id", F.round(F.array_max("embedding"), 6).alias("largest"))


@query("WITH d AS (SELECT DISTINCT text FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) SELECT count(*) FILTER (text IN (SELECT text FROM benchmark)) AS hits, count(*) FILTER (text IS NOT NULL AND text NOT IN (SELECT text FROM benchmark)) AS misses FROM d")
def encode_reused(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the questions are stored; questions and documents are asked for."""
    q = table(spark, sf, "benchmark").select("text").distinct()
    asked = table(spark, sf, "documents").select("text").unionByName(q).filter("text is not null")
    embed = lambda d: vectors.hashed_terms(d, "text", "text")
    return vectors.encode_with_reuse(asked, embed(q), "text", embed)[1]


@query(f"WITH {BM25} SELECT query_id, bm.doc_id, rank, length(d.text)::INT AS n FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE rank <= 5")
def fetch_hits(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.fetch(bm25_hits(spark, sf, 5), table(spark, sf, "documents").select("doc_id", "text")).select("query_id", "doc_id", "rank", F.length("text").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def corpus_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.sample_corpus(table(spark, sf, "documents"), 200, "doc_id").select("doc_id")


@query(f"WITH {_measures()}, su AS ({SUMMARY}) SELECT m.method, su.metric, su.mean FROM su, (VALUES ('cosine'), ('dot')) AS m(method)")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors: the two measures name the same neighbours."""
    e = table(spark, sf, "embeddings")
    settings = {m: (lambda q, m=m: vectors.knn_exact(q, e, 10, metric=m)) for m in ("cosine", "dot")}
    return evaluate.ablation(e.filter("vec_id % 20 = 0"), label_judgments(spark, sf), settings).select("method", "metric", "mean")


@query("SELECT count(*) AS vectors, count(DISTINCT doc_id) AS articles FROM documents")
def incremental_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs whose rows overlap: what the first has processed is not encoded again."""
    out = io.new_folder(spark, "incremental")
    a = _articles(spark, sf)
    embed = lambda d: vectors.hashed_terms(d, "pmid", "text")
    for part in (a.filter("cast(pmid as bigint) % 3 <> 0"), a):
        incremental.run(part, f"{out}/done", f"{out}/store", embed)
    return spark.read.parquet(f"{out}/store").agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("pmid").alias("articles"))


FILES = "f AS (SELECT DISTINCT doc_id, source, coalesce(try_cast(substr(source, 4) AS INT), 0) % 2 AS late FROM documents WHERE source IS NOT NULL)"


@query(f"""WITH {FILES} SELECT 0 AS turn, 'updated' AS status, (SELECT count(DISTINCT source) FROM f WHERE late = 0) AS new, 0::BIGINT AS modified, 0::BIGINT AS deleted, (SELECT count(*) FROM f WHERE late = 0) AS added
UNION ALL SELECT 1, 'updated', (SELECT count(DISTINCT source) FROM f WHERE late = 1), 0, 0, (SELECT count(*) FROM f WHERE late = 1) UNION ALL SELECT 2, 'no_changes', 0, 0, 0, 0""")
def check_and_update(spark: SparkSession, sf: str) -> DataFrame:
    """Topic files come in two lots; a third look finds nothing new."""
    out = io.new_folder(spark, "update")
    a = _articles(spark, sf).drop("_bucket")
    late = F.coalesce(F.substring("topic", 4, 10).try_cast("int"), F.lit(0)) % 2
    embed = lambda d: vectors.hashed_terms(d, "pmid", "text")
    read = lambda s, files: s.read.schema(io.ARTICLE).json(files)
    told = None
    for turn in range(3):
        if turn < 2:
            io.write_topic_files(a.filter(late == turn), f"{out}/files/lot{turn}")
        row = incremental.check_and_update(spark, f"{out}/files", f"{out}/manifest", f"{out}/done", f"{out}/store", embed, read).select(F.lit(turn).alias("turn"), "*")
        row = io.cut(row)
        told = row if told is None else told.unionByName(row)
    return told


@query("SELECT count(*) AS consumed, count(*) FILTER (length(coalesce(text, '')) < 100) AS failed, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents")
def stream_observed(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that a stream reports with its batches, added up."""
    from .streams import _files

    out = io.new_folder(spark, "observed")
    text = F.coalesce("text", F.lit(""))
    stream = stages.counted(_files(spark, sf, "documents"), "counters", F.length(text) < 100, F.octet_length(text))
    with stages.counter_log(spark, f"{out}/counters", "counters"):
        stages.write(stream, f"{out}/data", f"{out}/offsets").awaitTermination()
    return stages.read_counters(spark, f"{out}/counters").agg(*[F.sum(c).alias(c) for c in ("consumed", "failed", "bytes")])


@query(f"WITH {BM25} SELECT b.item_id AS query_id, b.item_id % 3 = 0 AS from_store, CASE WHEN b.item_id % 3 = 0 THEN 0 ELSE coalesce(h.hits, 0) END AS hits FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS hits FROM bm WHERE rank <= 5 GROUP BY query_id) h ON h.query_id = b.item_id")
def answered_batch(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    from ..operators import lexical

    index = lexical.build(table(spark, sf, "documents"))
    reuse = q.select("query_id", F.when(F.col("query_id") % 3 == 0, F.lit(1)).alias("cached_id"))
    return incremental.answer_batch(q, reuse, lambda rest: lexical.bm25(index, rest, 5))[0]


# The whole retrieval path in SQL: hashed vectors, BM25, fusion, overlap.
def _vectors_sql(name: str, key: str, text: str, source: str) -> str:
    return f"""{name}_t AS (SELECT {key} AS id, unnest({TOKENS.format(text)}) AS t FROM {source}), {name}_c AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS i, count(*)::DOUBLE AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, i, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM {name}_c)"""


def _nearest_sql(name: str, asked: str, k: int) -> str:
    return f"""{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.x * d.x), 6) AS score FROM {asked} q JOIN dv d ON d.i = q.i GROUP BY ALL
 UNION ALL SELECT q.id, d.id, 0.0 FROM (SELECT DISTINCT id FROM {asked}) q, (SELECT DISTINCT id FROM dv) d WHERE NOT EXISTS (SELECT 1 FROM {asked} a JOIN dv b ON a.i = b.i WHERE a.id = q.id AND b.id = d.id)) QUALIFY rank <= {k})"""


FUSED = """fu AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 6) AS s FROM li GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INT AS rank FROM fu QUALIFY rank <= {0})"""


@query(f"""WITH {BM25}, {_vectors_sql('dv', 'doc_id', 'text', 'documents')}, {_vectors_sql('qv', 'item_id', 'text', 'benchmark')}, {_nearest_sql('vn', 'qv', 15)},
li AS (SELECT query_id, doc_id, rank, 1.0 AS w FROM vn UNION ALL SELECT query_id, doc_id, rank, 1.0 FROM bm WHERE rank <= 15), {FUSED.format(15)},
h AS (SELECT fr.query_id, fr.doc_id, fr.rank, {TOKENS.format('b.text')} AS qt, {TOKENS.format('d.text')} AS dt FROM fr JOIN benchmark b ON b.item_id = fr.query_id JOIN documents d ON d.doc_id = fr.doc_id)
SELECT query_id, doc_id, {OVERLAP} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {OVERLAP} DESC, rank)::INT AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {OVERLAP} DESC, rank) <= 5""")
def retrieve_path(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and BM25 lists, fused by names, reranked by overlap: the whole path without a second attempt."""
    from ..operators import lexical

    docs = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    index, store = lexical.build(docs), vectors.hashed_terms(docs, "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    by_vector = lambda q, k: vectors.knn_exact(vectors.hashed_terms(q, "query_id", "query").withColumnRenamed("query_id", "vec_id"), store, k, exclude_self=False)
    return rerank.retrieve(questions(spark, sf), by_vector, lambda q, k: lexical.bm25(index, q, k), docs, 5).select("query_id", "doc_id", "score", "rank")


def _attempts_sql() -> str:
    """Both attempts of every question, as questions of two numbers each (2 i and 2 i + 1); the first stands where it is judged good."""
    from .talk import EXPANDED, EXTRA

    both = f"""b2 AS (SELECT item_id * 2 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, CASE WHEN len({EXTRA}) > 0 THEN {EXPANDED} || ' (' || array_to_string({EXTRA}, ' ') || ')' ELSE {EXPANDED} END FROM benchmark)"""
    words = "list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> ''))"
    return f"""WITH {both}, {BM25.replace("FROM benchmark", "FROM b2")}, {_vectors_sql('dv', 'doc_id', 'text', 'documents')}, {_vectors_sql('qv', 'item_id', 'text', 'b2')}, {_nearest_sql('vn', 'qv', 15)},
li AS (SELECT query_id, doc_id, rank, 1.0 AS w FROM vn UNION ALL SELECT query_id, doc_id, rank, 1.0 FROM bm WHERE rank <= 15), {FUSED.format(15)},
h AS (SELECT fr.query_id, fr.doc_id, fr.rank, {TOKENS.format('b.text')} AS qt, {TOKENS.format('d.text')} AS dt FROM fr JOIN b2 b ON b.item_id = fr.query_id JOIN documents d ON d.doc_id = fr.doc_id),
o AS (SELECT query_id, doc_id, {OVERLAP} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {OVERLAP} DESC, rank)::INT AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {OVERLAP} DESC, rank) <= 5),
g AS (SELECT query_id, count(*) AS n, max(score) AS top, avg(score) AS mean FROM o GROUP BY query_id),
c AS (SELECT g.*, {words} AS ws FROM g JOIN b2 b ON b.item_id = g.query_id),
v AS (SELECT query_id, count(*) AS covered FROM (SELECT DISTINCT c.query_id, u.w FROM c, unnest(c.ws) AS u(w) JOIN o ON o.rank <= 3 JOIN documents d ON d.doc_id = o.doc_id WHERE o.query_id = c.query_id AND contains(lower(coalesce(d.text, '')), u.w)) GROUP BY query_id),
j AS (SELECT query_id, round(least(n / 5, 1.0) * 3 + CASE WHEN top > 0 THEN 2.0 + 2 * mean / top ELSE 0.0 END + CASE WHEN len(ws) > 0 THEN coalesce(covered, 0) / len(ws) * 3 ELSE 0.0 END, 6) >= 5 OR (n >= 3 AND top > 0) AS good FROM c LEFT JOIN v USING (query_id)),
p AS (SELECT b.item_id, CASE WHEN j.good THEN 1 ELSE 2 END AS attempt FROM benchmark b LEFT JOIN j ON j.query_id = b.item_id * 2)
SELECT p.item_id AS query_id, o.doc_id, o.rank, o.score, p.attempt FROM p JOIN o ON o.query_id = p.item_id * 2 + p.attempt - 1"""


@query(_attempts_sql())
def retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path: hashed-term vectors and BM25 lists, fusion by names, rerank; weak questions once more with enhanced text."""
    from ..operators import lexical
    from ..operators.querytext import enhanced
    from .talk import SYN, WORDS

    docs = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    index, store = lexical.build(docs), vectors.hashed_terms(docs, "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    by_vector = lambda q, k: vectors.knn_exact(vectors.hashed_terms(q, "query_id", "query").withColumnRenamed("query_id", "vec_id"), store, k, exclude_self=False)
    run = lambda q: rerank.retrieve(q, by_vector, lambda x, k: lexical.bm25(index, x, k), docs, 5).join(docs.select("doc_id", "text"), "doc_id")
    asked = questions(spark, sf)
    return rerank.retry_weak(asked, run(asked), run, lambda q: enhanced(q, SYN, WORDS)).select("query_id", "doc_id", "rank", "score", "attempt")


def _ensemble_sql() -> str:
    from .talk import EXPANDED, EXTRA, SYN_CASE

    plain = f"pl AS (SELECT item_id, text AS query, {EXPANDED} AS text FROM benchmark)"
    wide = f"wi AS (SELECT item_id, ({SYN_CASE})[2] AS text FROM pl WHERE len(list_distinct({SYN_CASE})) > 1)"
    rich = f"benchmark_rich AS (SELECT item_id, CASE WHEN len({EXTRA}) > 0 THEN {EXPANDED} || ' (' || array_to_string({EXTRA}, ' ') || ')' ELSE {EXPANDED} END AS text FROM benchmark)"
    shape = "len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''))"
    known = "(contains(lower(query), 'tion') OR contains(lower(query), 'der'))"
    ask = "(ends_with(trim(query), '?') OR starts_with(query, 'what') OR starts_with(query, 'how') OR starts_with(query, 'why') OR starts_with(query, 'when') OR starts_with(query, 'which'))"
    pick = lambda a, b, c: f"CASE WHEN {shape} <= 3 THEN {a} WHEN {ask} AND {known} THEN {b} ELSE {c} END"
    weights = f"""we AS (SELECT pl.item_id AS query_id, CASE WHEN wi.item_id IS NOT NULL THEN {pick(0.35, 0.35, 0.4)} WHEN {shape} <= 3 THEN 0.45 ELSE 0.55 END::DOUBLE AS vector, CASE WHEN wi.item_id IS NOT NULL THEN {pick(0.25, 0.4, 0.35)} ELSE 0 END::DOUBLE AS expanded,
 CASE WHEN wi.item_id IS NOT NULL THEN {pick(0.4, 0.25, 0.25)} WHEN {shape} <= 3 THEN 0.55 ELSE 0.45 END::DOUBLE AS text FROM pl LEFT JOIN wi USING (item_id))"""
    bm = BM25.replace("FROM benchmark", "FROM benchmark_rich")
    return f"""WITH {rich}, {bm}, {plain}, {wide}, {weights}, {_vectors_sql('dv', 'doc_id', 'text', 'documents')}, {_vectors_sql('qv', 'item_id', 'text', 'pl')}, {_vectors_sql('wv', 'item_id', 'text', 'wi')},
{_nearest_sql('vn', 'qv', 30)}, {_nearest_sql('wn', 'wv', 20)},
li AS (SELECT query_id, doc_id, rank, vector AS w FROM vn JOIN we USING (query_id) UNION ALL SELECT query_id, doc_id, rank, expanded FROM wn JOIN we USING (query_id) UNION ALL SELECT query_id, doc_id, rank, text FROM bm JOIN we USING (query_id) WHERE rank <= 30),
{FUSED.format(10)} SELECT query_id, doc_id, s AS rrf_score, rank FROM fr"""


@query(_ensemble_sql())
def retrieve_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import lexical
    from .talk import SYN, WORDS

    docs = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    index, store = lexical.build(docs), vectors.hashed_terms(docs, "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    by_vector = lambda q, k: vectors.knn_exact(vectors.hashed_terms(q, "query_id", "query").withColumnRenamed("query_id", "vec_id"), store, k, exclude_self=False)
    return rerank.ensemble(questions(spark, sf), by_vector, lambda q, k: lexical.bm25(index, q, k), 10, SYN, WORDS, ("tion", "der")).select("query_id", "doc_id", "rrf_score", "rank")
