from __future__ import annotations

import json

from pyspark.sql import functions as F

from corvane.operators import vectors
from corvane.sources import tables, xml
from corvane.streaming import stages

ARTICLES = [{"pmid": "1", "title": "T", "abstract": "A" * 120, "authors": ["x"], "topic": None, "full_text": "T\n\nA"}, {"pmid": "2", "title": "U", "abstract": "B", "topic": ""}]


def test_json_of_all_shapes(spark, tmp_path):
    (tmp_path / "line.json").write_text(json.dumps(ARTICLES))
    (tmp_path / "many.json").write_text("\n".join(map(json.dumps, ARTICLES)))
    (tmp_path / "nice.json").write_text(json.dumps(ARTICLES, indent=2))
    for name, multi in (("line", False), ("many", False), ("nice", True)):
        assert [r.pmid for r in tables.read_articles(spark, f"{tmp_path}/{name}.json", multi).orderBy("pmid").collect()] == ["1", "2"]


def test_topic_files(spark, tmp_path):
    (tmp_path / "checkpoint_heart disease.data.json").write_text(json.dumps(ARTICLES))
    got = {r.pmid: r.topic for r in tables.read_topic_files(spark, f"{tmp_path}/checkpoint_*.data.json").collect()}
    assert got == {"1": "heart disease", "2": ""}


def test_judged(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "b", "query": "q", "relevant_doc_ids": ["1", "2"], "relevance_grades": [3, 1]}, {"id": "a", "query": "r", "relevant_doc_ids": ["9"], "relevance_grades": [2]}]))
    judged = tables.read_judged(spark, f"{tmp_path}/q.json")
    assert {tuple(r) for r in tables.judgments(judged).collect()} == {("b", "1", 3), ("b", "2", 1), ("a", "9", 2)}
    assert tables.read_judged(spark, f"{tmp_path}/q.json", 1).first().id == "a"


def test_xml(spark, tmp_path):
    authors = "".join(f"<Author><LastName>L{i}</LastName><ForeName>F{i}</ForeName></Author>" for i in range(7))
    (tmp_path / "a.xml").write_text(f"""<Set><PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><ArticleTitle>Title</ArticleTitle><Abstract><AbstractText Label="A">{'x' * 90}</AbstractText><AbstractText>{'y' * 20}</AbstractText></Abstract><AuthorList>{authors}</AuthorList><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Jan</Month></PubDate></JournalIssue></Journal></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D1">Heart</DescriptorName></MeshHeading></MeshHeadingList><KeywordList><Keyword MajorTopicYN="N">k1</Keyword></KeywordList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><ArticleTitle>Short</ArticleTitle><Abstract><AbstractText>tiny</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></Set>""")
    a = xml.read_articles(spark, f"{tmp_path}/a.xml", "hearts").collect()
    assert len(a) == 1 and (a[0].pmid, a[0].pub_date, a[0].authors, a[0].mesh_terms, a[0].keywords) == ("11", "2020-Jan", [f"F{i} L{i}" for i in range(5)], ["Heart"], ["k1"])
    assert a[0].abstract == "x" * 90 + " " + "y" * 20 and a[0].full_text.startswith("Title\n\nx")
    assert xml.read_abstracts(spark, f"{tmp_path}/a.xml", "hearts").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.range(20).withColumn("x", F.lit("y"))
    tables.write_parquet(df, f"{tmp_path}/p")
    assert tables.read_columns(spark, f"{tmp_path}/p", ["id"]).columns == ["id"]
    tables.write_sample(df, f"{tmp_path}/s", "id", 5)
    assert [r.id for r in spark.read.json(f"{tmp_path}/s").orderBy("id").collect()] == [0, 1, 2, 3, 4]
    tables.append_stamped(df, f"{tmp_path}/a", F.lit("2024-01-01").cast("timestamp"))
    tables.append_stamped(df, f"{tmp_path}/a", F.lit("2024-01-02").cast("timestamp"))
    assert spark.read.parquet(f"{tmp_path}/a").select("created_at").distinct().count() == 2
    listed = tables.list_objects(spark, f"{tmp_path}/p", "part-")
    assert listed.count() >= 1 and listed.columns == ["name", "size_mb", "last_modified"]
    assert tables.vector_rows(spark.range(1).select(F.repeat(F.lit("x"), 3000).alias("chunk_text"))).select(F.length("chunk_text")).first()[0] == 2000
    assert tables.attach_vectors(df.withColumnRenamed("id", "chunk_id"), spark.range(3).withColumnRenamed("id", "chunk_id")).count() == 3


def test_streams_equal_batches(spark, tmp_path):
    rows = [(str(i), ("Sentence number %d. " % i) * 60) for i in range(6)]
    schema = "pmid string, text string"
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stages.read_files(spark, f"{tmp_path}/in", schema, most=1)
    stages.write(stages.chunked(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    batch = stages.chunked(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))
    work = stages.encoded_batches(lambda b: vectors.hashed_terms(b, "chunk_id", "chunk_text"), f"{tmp_path}/v")
    chunks = stages.read_files(spark, f"{tmp_path}/out", "pmid string, chunk_no int, chunk_text string, chunk_id string")
    stages.each_batch(chunks, work, f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/v").count() == batch.count()
    message = stages.as_messages(spark.createDataFrame(rows[:1], schema)).first()
    assert message.key == "0" and json.loads(message.value)["pmid"] == "0"


def test_observed_counters(spark):
    from pyspark.sql import Observation

    seen = Observation("counters")
    df = spark.range(5).observe(seen, F.count(F.lit(1)).alias("n"))
    df.collect()
    assert seen.get["n"] == 5
    assert stages.counted(spark.range(3), "c", F.col("id") > 1, F.lit(1)).count() == 3
