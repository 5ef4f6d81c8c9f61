"""Retrieval within documents, and the answer that asks back, on literal rows; and stored tables that follow their files."""

import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factweave.operators import scoped
from factweave.plans.corpus_graph import Corpus

CHUNKS = [("a1", 1, 9.0), ("b1", 2, 8.0), ("a2", 1, 7.0), ("c1", 3, 6.0), ("a3", 1, 5.0), ("a4", 1, 4.0), ("b2", 2, 3.0), ("d1", 4, 1.0)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(1, "Alpha report"), (2, "Betatron"), (3, None), (4, "Delta")], "id long, title string")


def search(spark, asked):
    rows = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id long, score double").withColumn("title", F.lit(None).cast("string"))

    def retrieve(limit, documents, per_document):
        asked.append((limit, documents is not None, per_document))
        found = rows if documents is None else rows.join(documents.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        return found.orderBy(F.desc("score")).limit(limit).withColumn("rank", (10 - F.col("score")).cast("int"))

    return retrieve


@pytest.mark.parametrize(
    ("question", "limit", "options", "want"),
    [
        ("x", 3, {"forced": 2}, (["b1", "b2"], "explicit", "user_filter", "explicit_document")),
        ("x", 8, {"chosen": "id IN (3, 4)"}, (["c1", "d1"], "multi", "structured_filters", "structured_filters")),
        ("x", 2, {"chosen": "false"}, (["a1", "b1"], "single", "primary_relevance", "structured_fallback")),
        ("what is in all documents", 2, {}, (["a1", "b1"], "aggregate", "aggregate_query", "full_corpus")),
        ("what of the betatron", 3, {}, (["b1", "b2"], "explicit", "title_in_query", "full_corpus")),
        ("compare x and y", 2, {}, (["a1", "b1"], "multi", "comparison_query", "full_corpus")),
        ("x", 8, {}, (["a1", "a2", "a3", "a4"], "single", "primary_relevance", "full_corpus")),
        ("betatron and delta", 4, {}, (["b1"], "multi", "multiple_titles_in_query", "full_corpus")),
    ],
)
def test_ways(spark, documents, question, limit, options, want):
    asked = []
    if "chosen" in options:
        options = {"chosen": documents.where(options["chosen"]).select("id")}
    found, *rest = scoped.retrieve_scoped(question, search(spark, asked), documents, limit=limit, **options)
    assert ([r.chunk_id for r in found.orderBy("rank").collect()], *rest) == want
    # Four chunks and half of the limit are enough; else the document is searched alone, as far as the limit.
    assert len(asked) == (2 if rest[1] == "title_in_query" else 1) and asked[-1][2] == (limit if len(asked) == 2 else None)


def test_choice(spark, documents):
    scores = spark.createDataFrame([(1, 9.0, "Alpha"), (2, 8.0, ""), (3, 1.0, None), (4, 0.5, "D"), (5, 0.1, "E")], "doc_id long, score double, title string")
    r = scoped.choice_answer(scores).first()
    assert r.answer.splitlines()[-4:] == ["- Alpha", "- 2", "- 3", "- D"] and [c.doc_id for c in r.candidates] == [1, 2, 3, 4]
    assert scoped.choice_answer(scores, ratio=0.95).count() == 0 and scoped.choice_answer(scores.limit(1)).count() == 0 and scoped.choice_answer(scores.limit(0)).count() == 0
    assert scoped.asks_back("x", scores, documents, forced=1) is None and scoped.asks_back("compare them", scores, documents) is None and scoped.asks_back("x", scores, documents.limit(3)) is None
    assert scoped.asks_back("x", scores, documents, language="ru").count() == 1


def test_stored_tables_follow_their_files(spark, tmp_path):
    for name in os.listdir("/root/testdata/sf0.001"):
        shutil.copy(f"/root/testdata/sf0.001/{name}", tmp_path)
    folder = str(tmp_path)
    first = Corpus(spark, folder)._items
    assert Corpus(spark, folder)._items is first
    pq.write_table(pq.read_table(f"{folder}/lineitem.parquet").slice(0, 10), f"{folder}/lineitem.parquet")
    assert Corpus(spark, folder)._items.count() == 10
    again = Corpus(spark, folder)._items
    shutil.rmtree(again.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert Corpus(spark, folder)._items.count() == 10


def test_contradiction_classes(spark):
    from types import SimpleNamespace

    from factweave.operators import analytics

    e = "src string, dst string, type string, value string"
    rows = [(x, m, "USES_MATERIAL", None) for x, m in (("e1", "m"), ("e2", "m"), ("e3", "m"), ("e4", "n"))] + [("e1", "d", "DESCRIBED_IN", None)]
    values = [("e1", "p", "MEASURED", "1"), ("e2", "p", "MEASURED", "2"), ("e3", "p", "MEASURED", "2"), ("e4", "p", "MEASURED", "9"), ("e3", "q", "MEASURED", None)]
    corpus = SimpleNamespace(edges=spark.createDataFrame(rows, e), measured=spark.createDataFrame(values, e))
    got = sorted(map(tuple, analytics.contradiction_classes(corpus, spark.createDataFrame([("m",), ("n",)], "id string")).collect()))
    assert got == [("m", "p", "1", 1, 2, "e1", "d", "2", "e2"), ("m", "p", "2", 2, 1, "e2", None, "1", "e1")]
