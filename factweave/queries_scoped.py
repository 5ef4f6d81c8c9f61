"""Registered queries of retrieval within documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import retrieval, scoped
from factweave.plans.corpus_graph import Corpus
from factweave.registry import query

TERMS = ["the", "que", "der", "tion"]
#: Questions that reach each way of narrowing: name, question, forced document, whether filters are set.
CASES = [
    ("forced", "what is it", 5, None), ("filtered", "what is it", None, "lang = 'fr'"), ("filtered away", "what is it", None, "false"), ("all", "summarise all documents", None, None),
    ("named", "what does paper00007 say", None, None), ("two named", "paper00003 or else paper00007", None, None), ("compared", "compare them", None, None), ("best", "what is it", None, None),
]


def _titles(c: Corpus) -> DataFrame:
    return c.table("documents").select(F.col("doc_id").alias("id"), F.format_string("paper%05d", "doc_id").alias("title"), "lang")


def _retriever(c: Corpus):
    """Keyword search: the best chunks by hits, of some documents alone where they are given."""
    titles = _titles(c).select(F.col("id").alias("doc_id"), "title")

    def retrieve(limit: int, documents: DataFrame | None, per_document: int | None) -> DataFrame:
        chunks = c.chunks if documents is None else retrieval.in_documents(c.chunks, documents)
        best = retrieval.keyword_topk(chunks, TERMS, limit)
        order = Window.orderBy(F.desc("hits"), "chunk_index", "doc_id")  # a page of results
        return best.withColumn("rank", F.row_number().over(order)).join(titles, "doc_id").select("chunk_id", "doc_id", "title", "rank", F.col("hits").cast("double").alias("score"))

    return retrieve


_HITS = " + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS)
_K = f""", h AS (SELECT chunk_id, doc_id, chunk_index, ({_HITS}) AS hits FROM chunks WHERE ({_HITS}) > 0),
k AS (SELECT chunk_id, doc_id, hits, row_number() OVER (ORDER BY hits DESC, chunk_index, doc_id) AS rank FROM h QUALIFY rank <= 10),
own AS (SELECT chunk_id, doc_id, hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk_index) AS rank FROM h QUALIFY rank <= 10),
top AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1 ORDER BY sum(hits) DESC, doc_id LIMIT 1),
chosen AS (SELECT chunk_id, doc_id, row_number() OVER (ORDER BY hits DESC, chunk_index, doc_id) AS rank FROM h WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') QUALIFY rank <= 10),
best AS (SELECT chunk_id, own.doc_id FROM own JOIN top USING (doc_id) WHERE n < 5 UNION ALL SELECT chunk_id, k.doc_id FROM k JOIN top USING (doc_id) WHERE n >= 5)"""


@query(f"""{_K} SELECT 'forced' AS question, 'explicit' AS mode, 'user_filter' AS reason, 'explicit_document' AS narrowed, chunk_id FROM own WHERE doc_id = 5
UNION ALL SELECT 'filtered', 'multi', 'structured_filters', 'structured_filters', chunk_id FROM chosen
UNION ALL SELECT 'filtered away', 'single', CASE WHEN (SELECT count(DISTINCT doc_id) FROM k) = 1 THEN 'only_one_document' ELSE 'primary_relevance' END, 'structured_fallback', chunk_id FROM k
UNION ALL SELECT 'all', 'aggregate', 'aggregate_query', 'full_corpus', chunk_id FROM k
UNION ALL SELECT 'named', 'explicit', 'title_in_query', 'full_corpus', chunk_id FROM own WHERE doc_id = 7
UNION ALL SELECT 'two named', 'multi', 'multiple_titles_in_query', 'full_corpus', chunk_id FROM k WHERE doc_id IN (3, 7) OR (SELECT count(*) FROM k WHERE doc_id IN (3, 7)) = 0
UNION ALL SELECT 'compared', 'multi', 'comparison_query', 'full_corpus', chunk_id FROM k
UNION ALL SELECT 'best', 'single', CASE WHEN (SELECT count(DISTINCT doc_id) FROM k) = 1 THEN 'only_one_document' ELSE 'primary_relevance' END, 'full_corpus', chunk_id FROM best""")  # fmt: skip
def scoped_retrieval(c: Corpus) -> DataFrame:
    out, titles, retrieve = None, _titles(c), _retriever(c)
    for name, question, forced, chosen in CASES:
        rows, mode, reason, narrowed = scoped.retrieve_scoped(question, retrieve, titles.select("id", "title"), forced=forced, chosen=None if chosen is None else titles.withColumnRenamed("id", "doc_id").where(chosen).select(F.col("doc_id").alias("id")))
        rows = rows.select(*(F.lit(x).alias(n) for n, x in (("question", name), ("mode", mode), ("reason", reason), ("narrowed", narrowed))), "chunk_id")
        out = rows if out is None else out.union(rows)
    return out


@query(f"""{_K}, s AS (SELECT doc_id, count(*)::DOUBLE AS score FROM h GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM s QUALIFY n <= 4)
SELECT 'Relevant information was found in multiple documents. Select a document from the filter above and search again:' || chr(10) || chr(10) || string_agg('- paper' || lpad(doc_id::VARCHAR, 5, '0'), chr(10) ORDER BY n) AS answer FROM c HAVING max(score) FILTER (n = 2) >= 0.5 * max(score) FILTER (n = 1)""")  # fmt: skip
def choice_answers(c: Corpus) -> DataFrame:
    """The answer that asks back, with the documents of the most chunks with hits as candidates."""
    hits = retrieval.keyword_hits(c.chunks, TERMS).groupBy("doc_id").agg(F.count("*").cast("double").alias("score"))
    titled = hits.join(_titles(c).select(F.col("id").alias("doc_id"), "title"), "doc_id")
    return scoped.choice_answer(titled, ratio=0.5).select("answer")
