"""Article XML: bibliographic records with title, abstract, authors, terms and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,"
    "Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<struct<_VALUE:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,"
    "Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,Month:string>>>>,"
    "KeywordList:struct<Keyword:array<struct<_VALUE:string>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>>"
)


def _first(c: Column, n: int) -> Column:
    return F.coalesce(F.slice(F.array_compact(c), 1, n), F.array().cast("array<string>"))


def read_articles(spark: SparkSession, path: str, topic: str, least: int = 100) -> DataFrame:
    """Articles with an abstract of at least ``least`` characters: five authors, ten MeSH terms and ten keywords at most."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(SCHEMA).load(path).select("MedlineCitation.*")
    abstract = F.array_join(F.transform("Article.Abstract.AbstractText", lambda x: x["_VALUE"]), " ")
    date = F.col("Article.Journal.JournalIssue.PubDate")
    return (
        raw.select(
            F.col("PMID._VALUE").alias("pmid"),
            F.col("Article.ArticleTitle").alias("title"),
            abstract.alias("abstract"),
            _first(F.transform("Article.AuthorList.Author", lambda a: F.when(a["LastName"].isNotNull(), F.concat_ws(" ", a["ForeName"], a["LastName"]))), 5).alias("authors"),
            F.concat_ws("-", date["Year"], date["Month"]).alias("pub_date"),
            _first(F.transform("KeywordList.Keyword", lambda k: k["_VALUE"]), 10).alias("keywords"),
            _first(F.transform("MeshHeadingList.MeshHeading", lambda m: m["DescriptorName"]["_VALUE"]), 10).alias("mesh_terms"),
            F.lit(topic).alias("topic"),
        )
        .filter(F.length("abstract") >= least)
        .withColumn("full_text", F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("abstract")))
    )


def read_abstracts(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """The reduced load: pmid, title, abstract, topic and full text of every article with any abstract."""
    return read_articles(spark, path, topic, least=1).select("pmid", "title", "abstract", "topic", "full_text")
