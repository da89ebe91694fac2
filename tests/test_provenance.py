"""Files and the vectors of their articles, turn by turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import provenance
from corvane.plans import kept
from corvane.sources import tables as io


def test_turns_count_files_and_articles(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("source is not null").select("doc_id", "source").collect()
    first, second = {r.source for r in docs}, {r.source for r in docs if r.doc_id % 5 == 0}
    out, told = kept.files_turns(spark, data)
    told = [tuple(t.first()) for t in told]
    assert told[0] == ("updated", len(first) + len(second), 0, 0, len(docs), 0, 0)
    assert told[1] == ("no_changes", 0, 0, 0, 0, 0, 0)
    after = {r.source for r in docs if r.doc_id % 4}
    gone = [r for r in docs if r.doc_id % 4 == 0 and r.doc_id % 5]
    assert told[2] == ("updated", 0, len(after), len(first - after), 0, len([r for r in docs if r.doc_id % 4 and r.doc_id % 5]), len(gone))


def folder_of(spark, out, files):
    """One JSON file a name, under stable paths."""
    kept._delete(spark, f"{out}/files")
    for name, rows in files.items():
        df = spark.createDataFrame([(a, t, name) for a, t in rows], "pmid string, abstract string, topic string")
        io.write_topic_files(df, f"{out}/files/{name}")


def test_texts_of_several_files(spark, monkeypatch):
    out = io.new_folder(spark, "provenance")
    seen = []

    def embed(d):
        seen.append(sorted((r.article, r.text) for r in d.collect()))
        return d.select("article", F.array(F.length("text").cast("double")).alias("embedding"))

    turn = lambda: tuple(provenance.synchronise(spark, f"{out}/files", f"{out}/home", kept._read_articles, embed, by_content=True).first())
    state = lambda: {r.article: r.embedding for r in provenance.vectors(spark, f"{out}/home").collect()}
    folder_of(spark, out, {"a": [("1", "one"), ("2", "two"), (None, "nobody's")], "b": [("2", "second"), ("3", None)]})
    assert turn() == ("updated", 2, 0, 0, 3, 0, 0) and state() == {"1": [3.0], "2": [6.0], "3": [0.0]}
    # b no longer holds 2: a's text counts again, though a was not read.
    folder_of(spark, out, {"a": [("1", "one"), ("2", "two"), (None, "nobody's")], "b": [("3", None)]})
    assert turn() == ("updated", 0, 1, 0, 0, 1, 0) and state() == {"1": [3.0], "2": [3.0], "3": [0.0]}
    assert seen[-1] == [("2", "two")]
    # A turn that breaks before its commit is not seen and comes again.
    folder_of(spark, out, {"b": [("3", "three"), ("4", "four")]})
    with monkeypatch.context() as m:
        m.setattr(provenance, "released", lambda *a: 1 / 0)
        m.setattr(provenance, "articles", lambda *a: 1 / 0)
        try:
            turn()
        except ZeroDivisionError:
            pass
    assert state() == {"1": [3.0], "2": [3.0], "3": [0.0]}
    assert turn() == ("updated", 0, 1, 1, 1, 1, 2) and state() == {"3": [5.0], "4": [4.0]}
    monkeypatch.setattr(provenance, "PATHS", 1)
    folder_of(spark, out, {"b": [("3", "three"), ("4", "four")], "c": [("5", "five")], "d": [("6", "six")]})
    assert turn() == ("updated", 2, 0, 0, 2, 0, 0)
    folder_of(spark, out, {"z": [(None, "x")]})
    assert turn()[1:] == (1, 0, 3, 0, 0, 4) and state() == {}
