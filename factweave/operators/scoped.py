"""Retrieval within the documents that a question is about, and the answer that asks back where they are not clear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import questions as Q
from factweave.operators.retrieval import document_scope, document_scores
from factweave.store import kept

#: What stands before the titles to choose from.
ASK = {
    "en": "Relevant information was found in multiple documents. Select a document from the filter above and search again:\n",
    "ru": "Найдена релевантная информация в нескольких документах. Выберите документ в фильтре выше и повторите поиск:\n",
}


def choice_answer(scores: DataFrame, language: str = "en", *, ratio: float = 0.88, most: int = 4) -> DataFrame:
    """The answer where the second document scores ``ratio`` of the first or more: answer, candidates (doc_id, title, score; the best ``most``); no row where the first is clear.

    Only the best few documents are put in order in one place.
    """
    best = scores.orderBy(F.desc("score"), "doc_id").limit(most).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    one = best.agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "title", F.round("score", 4).alias("score")))).alias("c"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    label = lambda x: F.concat(F.lit("- "), F.coalesce(F.nullif(x["title"], F.lit("")), F.left(x["doc_id"].cast("string"), F.lit(8))))
    lines = F.concat(F.array(F.lit(ASK[language])), F.transform("c", label))
    rows = one.where((F.col("first") > 0) & (F.col("second") / F.col("first") >= ratio))
    return rows.select(F.array_join(lines, "\n").alias("answer"), F.transform("c", lambda x: F.struct(x["doc_id"], x["title"], x["score"])).alias("candidates"))


def asks_back(question: str, scores: DataFrame, documents: DataFrame, *, forced=None, filtered: bool = False, language: str = "en") -> DataFrame | None:
    """choice_answer, if the question leaves the document open: none is forced or filtered for, it neither compares nor asks about all, and there are more than three."""
    if forced is not None or filtered or documents.limit(4).count() <= 3:
        return None
    q = F.lit(question)
    if documents.sparkSession.range(1).select(Q.asks_comparison(q) | Q.asks_aggregate(q)).first()[0]:
        return None
    return choice_answer(scores, language)


def retrieve_scoped(question: str, retrieve: Callable[..., DataFrame], documents: DataFrame, *, forced=None, chosen: DataFrame | None = None, limit: int = 10) -> tuple[DataFrame, str, str, str]:
    """Chunks for a question from the documents that it is about: ranked chunks (doc_id, title, rank, score and others), mode and reason of the scope, and how the search was narrowed.

    ``retrieve(limit, documents, per_document)`` ranks chunks, of given documents (id) alone where they are given.  ``documents`` is id and title.

    - A ``forced`` document is searched alone (``explicit_document``).
    - ``chosen`` documents, those that filters left, are searched alone (``structured_filters``); if they are none, all are (``structured_fallback``).
    - Else all are searched (``full_corpus``).  About one document: its chunks among the found ones, if they are four and half of
      ``limit`` or more, else those of a search in it alone, if that finds any.  About several: the found ones of these, if any.
      About all, or without such chunks: what was found.
    """
    ids = lambda value: documents.where(F.col("id") == F.lit(value)).select("id")
    if forced is not None:
        found = kept(retrieve(limit, ids(forced), None))
        return found, "explicit", "user_filter", "explicit_document"
    if chosen is not None and not chosen.isEmpty():
        return kept(retrieve(limit, chosen.select("id"), None)), "multi", "structured_filters", "structured_filters"
    found = kept(retrieve(limit, None, None))
    mode, reason, scope = document_scope(question, found, documents)
    if chosen is not None:
        return found, mode, reason, "structured_fallback"
    inside = kept(found.join(scope.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
    if mode in ("single", "explicit") and not scope.isEmpty():
        if inside.count() >= max(4, limit // 2):
            return inside.orderBy("rank").limit(limit), mode, reason, "full_corpus"
        alone = kept(retrieve(limit, scope, limit))
        return (found if alone.isEmpty() else alone), mode, reason, "full_corpus"
    if mode == "multi" and not inside.isEmpty():
        return inside.orderBy("rank").limit(limit), mode, reason, "full_corpus"
    return found, mode, reason, "full_corpus"


__all__ = ["asks_back", "choice_answer", "document_scores", "retrieve_scoped"]
