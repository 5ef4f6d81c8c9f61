"""Persons and institutions of documents: harvested from heads, labels and rosters, and from running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.functions import people as P
from factweave.functions import text as T
from factweave.functions import values as V


def header_authors(pages: DataFrame, header: int = 1400, lines: int = 12) -> DataFrame:
    """Authors in the first ``header`` characters of pages (page_id, text): page_id, place, name.

    After labels; and of the first ``lines`` lines with text those that are one name before an institution,
    a long line or the end, or that list names.  Headings, capitals and lines with a year are passed over.
    """
    tops = pages.select("page_id", F.substring(F.coalesce("text", F.lit("")), 1, header).alias("top"))
    labelled = tops.select("page_id", F.posexplode(P._labelled(F.col("top"), V.HEADER_LABELS)).alias("j", "name")).select("page_id", F.lit(-1).alias("i"), "j", "name")
    rows = tops.select("page_id", F.posexplode(F.filter(F.transform(F.split("top", "\n"), T.strip), lambda x: x != "")).alias("i", "line"))
    rows = rows.withColumn("following", F.lead("line").over(Window.partitionBy("page_id").orderBy("i"))).where(F.col("i") < lines)
    line, after = F.col("line"), F.col("following")
    words = F.size(F.split(line, r"\s+"))
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & (words >= 3)
    dated = T.has(line, r"\d{4}") & (F.length(line) < 50)
    usable = rows.where((F.length(line) <= 100) & ~T.has(line, V.NO_AUTHOR_LINE) & ~K.heading(T.entity_name(line)) & ~capitals & ~dated)
    named = K.author_name(P.first_names_first(line)) & words.between(2, 5)
    below = P.affiliation_name(F.coalesce(after, F.lit("")))
    alone = named & ((~P.affiliation_name(line) & (after.isNull() | below | (F.length(after) > 60))) | ((words <= 4) & below))
    lists = T.has(line, rf"(?iu)(?<!{T.WORD})(?:and|&|и)(?!{T.WORD})|,")
    several = F.when(lists, P._split(F.array(line))).otherwise(F.array().cast("array<string>"))
    found = usable.select("page_id", "i", F.posexplode(F.when(alone, F.array(line)).otherwise(several)).alias("j", "name"))
    named = labelled.union(found).withColumn("name", P.first_names_first(F.col("name"))).where(K.author_name(F.col("name")))
    first = named.groupBy("page_id", F.lower("name").alias("key")).agg(F.min(F.struct("i", "j", "name")).alias("x"))
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("x")).alias("place"), F.col("x.name").alias("name"))


def document_people(chunks: DataFrame, front: int = 6, part: int = 4000, heads: int = 5, header: int = 3500) -> DataFrame:
    """Everybody whom a document (chunks: doc_id, chunk_index, text) names as author or expert, in order: doc_id, place, name.

    First labels and rosters of the beginnings (``part`` characters) of its first ``front`` chunks, then of
    the whole text, then the heads of the first ``heads`` chunks, then rosters of the whole text and numbered names of the front.
    """
    numbered = chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(rows, F.struct("n", "text")))), lambda x: x["text"]), "\n")
    begun = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= front, F.struct("n", F.substring("text", 1, part).alias("text"))))), lambda x: x["text"]), "\n")
    texts = numbered.groupBy("doc_id").agg(begun.alias("front"), joined(F.lit(True)).alias("whole"))
    of = lambda source, names: texts.select("doc_id", F.lit(source).alias("source"), F.posexplode(names).alias("at", "name")).select("doc_id", "source", F.lit(0).alias("page"), "at", "name")
    pages = numbered.where(F.col("n") <= heads).select(F.struct("doc_id", "n").alias("page_id"), F.substring("text", 1, part).alias("text"))
    head = header_authors(pages, header).select("page_id.doc_id", F.lit(2).alias("source"), F.col("page_id.n").alias("page"), F.col("place").alias("at"), "name")
    whole, start = F.col("whole"), F.col("front")
    rows = of(0, P.labelled_authors(start)).union(of(1, P.labelled_authors(whole))).union(head).union(of(3, P.listed_people(whole))).union(of(4, P.numbered_people(start)))
    first = rows.groupBy("doc_id", F.lower("name").alias("key")).agg(F.min(F.struct("source", "page", "at", "name")).alias("x"))
    return first.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("x")).alias("place"), F.col("x.name").alias("name"))


def document_organisations(chunks: DataFrame, plain: bool = False) -> DataFrame:
    """The institutions of each document (chunks: doc_id, chunk_index, text), the longest first: doc_id, place, name.

    Names with marks of slides or sections ("table", "copyright") are none, unless the texts are ``plain``.
    """
    texts = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return texts.select("doc_id", F.posexplode(P.organisations(F.col("text"), plain)).alias("at", "name")).select("doc_id", (F.col("at") + 1).alias("place"), "name")


def person_facts(excerpts: DataFrame, language: str = "en", parted: bool = False, parts: list[str] = V.NO_NAME_PARTS, ends: list[str] = V.PATRONYMIC_ENDS) -> DataFrame:
    """Persons who act in the excerpts (question_id, n, text) of a question, with the numbers of those that speak of them: question_id, name, claim, sources.

    The claim adds the role near the name in the first of them; in English no Russian one.  Words that ran together are parted
    unless the texts are ``parted``, single blanks between their words.  Names with ``parts`` or ``ends`` are no persons'.
    """
    text = F.coalesce("text", F.lit("")) if parted else P.parted_text(F.col("text"))
    rows = excerpts.select("question_id", "n", text.alias("text"))
    named = rows.select("question_id", "n", "text", F.explode(P.person_names(F.col("text"), parts, ends)).alias("name")).where(P.acts(F.col("text"), F.col("name")))
    merged = named.select("question_id", "n", "name", P.role_of(F.col("text"), F.col("name")).alias("role")).groupBy("question_id", "name").agg(F.min_by("role", "n").alias("role"), F.array_sort(F.collect_set("n")).alias("sources"))
    shown = F.col("role").isNotNull() & (F.lit(language != "en") | ~T.has(F.col("role"), T.CYRILLIC))
    return merged.select("question_id", "name", F.when(shown, F.concat_ws(" — ", "name", "role")).otherwise(F.col("name")).alias("claim"), "sources")
