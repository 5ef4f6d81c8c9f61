"""What goes into an answer's context: passages cut to what a question needs, budgets, and texts put together."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from factweave.functions import values as V

#: Characters before the passage that a window is moved to, the least a chunk is cut to, and what a chunk costs beside its text.
LEAD, LEAST, OVERHEAD = 480, 480, 72
_STAT = re.compile(V.STAT_LINE + r"\b", re.IGNORECASE)
_YEAR = re.compile(rf"\b{V.YEAR}\b")


def context_terms(question: str, terms: list[str], anchors: list[str]) -> list[str]:
    """Search terms, other wordings of phrases in the question, and its numbers, each once."""
    more = [v for phrase, variants in V.SYNONYMS.items() if phrase in question.lower() for v in variants]
    return list(dict.fromkeys([*terms, *more, *(a.lower() for a in anchors)]))


def stat_places(text: str, terms: list[str]) -> list[int]:
    """Where amounts stand that have a term of the subject within 140 characters."""
    subject = [t for t in terms if len(t) >= 4 and t not in V.NO_MATERIAL]
    low = text.lower()
    return [m.start() for m in _STAT.finditer(text) if not subject or any(t in low[max(0, m.start() - 140) : m.end() + 140] for t in subject)]


def cut_at(text: str, start: int, most: int) -> str:
    return f"{'…' if start else ''}{text[start : start + most].strip()}{'…' if start + most < len(text) else ''}"


def compressed_text(text: str | None, terms: list[str], most: int, cited: bool = False) -> str:
    """The window of ``most`` characters with most terms (an amount counts four, two more on a cited page), moved to begin shortly before the passage nearest to it."""
    text = (text or "").strip()
    if len(text) <= most:
        return text
    low, stats = text.lower(), stat_places(text, terms)
    places = [m.start() for t in terms if t for m in re.finditer(re.escape(t), low)] + [m.start() for m in _YEAR.finditer(text)] + stats
    if not terms or not places:
        return text[:most] + "…"

    def worth(start: int) -> int:
        window, inside = low[start : start + most], sum(start <= p < start + most for p in stats)
        return sum(t in window for t in terms) + 4 * inside + (2 if cited and inside else 0)

    best = max(range(0, max(1, len(text) - most), max(80, most // 4)), key=worth)
    anchor = min(stats or places, key=lambda p: abs(p - best))
    out = cut_at(text, max(0, anchor - LEAD), most)
    if cited and stats and not _STAT.search(out):
        out = cut_at(text, max(0, stats[0] - LEAD), most)
    return out


def compressed(text: Column, terms: list[str], most: Column, cited: Column) -> Column:
    """``compressed_text`` over columns."""

    @pandas_udf(StringType())
    def run(texts: pd.Series, sizes: pd.Series, pages: pd.Series) -> pd.Series:
        return pd.Series([compressed_text(t, terms, int(n), bool(c)) for t, n, c in zip(texts, sizes, pages, strict=True)])

    return run(text, most, cited)


def within_context(ranked: DataFrame, terms: list[str], total: int, each: int | None = None) -> DataFrame:
    """Chunks (chunk_id, rank, score, text, sources) cut and dropped until they fit into ``total`` characters: chunk_id, rank, text.

    Each is cut to ``each`` characters (an even share, 480 at least); then those with
    the lowest scores go, as far as three stay; then the rest is cut in proportion.
    """
    if each is None:
        each = max(LEAST, total // max(1, ranked.count()))
    cited = F.array_contains("sources", "page")
    short = ranked.withColumn("text", compressed(F.col("text"), terms, F.lit(each), cited)).withColumn("cost", F.length("text") + OVERHEAD)
    whole, lowest = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.coalesce("score", F.lit(0.0)), "rank")  # a context's few rows
    placed = short.withColumns({"n": F.count("*").over(whole), "all": F.sum("cost").over(whole), "i": F.row_number().over(lowest), "gone": F.sum("cost").over(lowest.rowsBetween(Window.unboundedPreceding, 0))})
    enough = (F.col("all") - F.col("gone") <= total) | (F.col("i") >= F.col("n") - 3)
    drop = F.when(F.col("all") <= total, 0).when(F.col("n") <= 3, 0).otherwise(F.min(F.when(enough, F.col("i"))).over(whole))
    kept = placed.withColumn("drop", drop).where(F.col("i") > F.col("drop")).withColumn("left", F.sum("cost").over(whole))
    size = F.greatest(F.lit(LEAST), F.floor(F.length("text") * total / F.col("left")).cast("int"))
    fits = (F.col("left") <= total) | (F.length("text") <= size)
    return kept.select("chunk_id", "rank", F.when(fits, F.col("text")).otherwise(compressed(F.col("text"), terms, size, cited)).alias("text"))


def assembled(chunks: DataFrame) -> DataFrame:
    """One text for each answer from its chunks (answer_id, rank, doc_id, title, text): numbered excerpts under a header for each document, in the order of ranks, and the sources: answer_id, context, sources."""
    number = F.row_number().over(Window.partitionBy("answer_id").orderBy("rank"))
    first = F.min("rank").over(Window.partitionBy("answer_id", "doc_id"))
    rows = chunks.withColumns({"n": number, "first": first})
    docs = rows.groupBy("answer_id", "first", "doc_id").agg(
        F.max("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: F.concat(F.lit("["), r["n"].cast("string"), F.lit("] "), r["text"])), "\n").alias("body"), F.min("n").alias("n")
    )
    block = F.concat(F.lit("## "), F.coalesce("title", F.lit("Document")), F.lit("\n"), "body")
    lists = F.array_sort(F.collect_list(F.struct("first", block.alias("block"), F.struct("n", "doc_id", "title").alias("source"))))
    return docs.groupBy("answer_id").agg(lists.alias("d")).select("answer_id", F.array_join(F.transform("d", lambda x: x["block"]), "\n\n").alias("context"), F.transform("d", lambda x: x["source"]).alias("sources"))


def experiment_line(material: Column, process: Column, title: Column, year: Column, place: Column) -> Column:
    """One line of a list of experiments."""
    where = F.when(F.coalesce(place, F.lit("")) != "", F.concat(F.lit(" | "), place)).otherwise("")
    return F.concat(F.lit("- Material: "), F.coalesce(material, F.lit("None")), F.lit(" | Process: "), F.coalesce(process, F.lit("None")), F.lit(" | Source: "), F.coalesce(title, F.lit("None")), F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n/d")), F.lit(")"), where)


def report(title: str, rows: DataFrame, line: Column, order: list[str]) -> DataFrame:
    """A Markdown report of a result's lines in order: one row, report."""
    placed = rows.select(F.struct(*order).alias("o"), line.alias("line"))
    return placed.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda r: r["line"]), "\n")).alias("report"))
