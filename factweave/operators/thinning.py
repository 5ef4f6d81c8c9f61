"""Thinning of chunk and batch lists, scans for terms, and excerpts by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.functions import text as T

#: Numbers and units that mark a text as dense in measurements.
MEASURES = r"(?i)(?:\d+(?:[.,]\d+)?|ph|mg/l|ppm|kpa|mpa|°c|℃|min|hours?|g/l|%|million|billion|tonnes?|tonne|mt|t/y|t/a|pa\b|g/l)"


def priority(text: Column) -> Column:
    """Measurements by four, 3 at most, and 1.5 for a table."""
    return F.least(F.lit(3.0), F.regexp_count(text, F.lit(MEASURES)) / 4) + F.when(F.contains(text, F.lit("[TABLE]")), 1.5).otherwise(0.0)


def _marked(rows: DataFrame, by: str, order: str, top: int, k: int, ends: int) -> DataFrame:
    """i, n, and whether a row stays: the ends, the ``top`` first by priority, and the rows of a stride."""
    group = Window.partitionBy(by)
    placed = rows.withColumns({"i": F.row_number().over(group.orderBy(order)) - 1, "n": F.count("*").over(group), "p": priority(F.col("text"))})
    place = F.row_number().over(group.orderBy(F.desc("p"), "i"))
    must = placed.withColumn("must", (F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | (place <= top))
    held = must.withColumn("held", F.count_if("must").over(group))
    stride = F.greatest(F.lit(1), F.floor((F.col("n") - ends) / F.greatest(F.lit(1), k - F.col("held"))))
    return held.withColumn("keep", F.col("must") | (F.col("i") % stride == 0))


def thin_chunks(chunks: DataFrame, k: int) -> DataFrame:
    """At most k chunks of each document: ends, the densest quarter, a stride, then the others in order."""
    marked = _marked(chunks, "doc_id", "chunk_index", max(6, k // 4), k, 0)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("keep"), "i"))
    return marked.withColumn("place", place).where(F.col("place") <= k).select("chunk_id", "doc_id")


def thin_batches(batches: DataFrame, k: int) -> DataFrame:
    """At most k batches (doc_id, pack, text) of each document, without filling up; the middle one if k is 1, all if k is 0."""
    if k <= 0:
        return batches.select("doc_id", "pack")
    marked = _marked(batches, "doc_id", "pack", max(2, k // 3), k, 1)
    chosen = F.col("i") == F.floor(F.col("n") / 2) if k == 1 else F.col("keep")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chosen"), "i"))
    placed = marked.withColumn("chosen", (F.col("n") <= k) | chosen).withColumn("place", place)
    return placed.where(F.col("chosen") & (F.col("place") <= k)).select("doc_id", "pack")


def term_scan(chunks: DataFrame, terms: DataFrame, words: int = 3) -> DataFrame:
    """Terms (term, of up to ``words`` tokens, four characters or more, no class of matter) that stand in a chunk as whole tokens: chunk_id, term.

    An equi-join of token n-grams with the terms, so neither side has to be small.
    """
    tokens = chunks.select("chunk_id", T.tokens(F.col("text")).alias("t"))

    def grams_of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("t", i, n), " "))

    grams = F.flatten(F.array(*(grams_of(n) for n in range(1, words + 1))))
    return tokens.select("chunk_id", F.explode(F.array_distinct(grams)).alias("term")).join(terms.select("term").where((F.length("term") >= 4) & ~K.generic_class(F.col("term"))).distinct(), "term", "left_semi").select("chunk_id", "term")


def per_document_top(ranked: DataFrame, per: int = 4, documents: int = 12) -> DataFrame:
    """The best chunks (chunk_id, doc_id, score) of each of the documents with the highest totals."""
    best = ranked.groupBy("doc_id").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "doc_id").limit(documents)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_id"))
    return ranked.join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi").withColumn("place", place).where(F.col("place") <= per)


def excerpts(top: DataFrame, chunks: DataFrame) -> DataFrame:
    """One text of numbered excerpts for each document: doc_id, context."""
    rows = top.join(chunks.select("chunk_id", "text"), "chunk_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: F.concat(F.lit("["), r["place"].cast("string"), F.lit("] "), r["text"]))
    return rows.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("context"))
