"""The corpus pipeline: stages from raw documents to encoded ones, each over all that its predecessor kept."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, decontaminate, language_id, line_dedup, ngram_jaccard
from factweave.llm.components import shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least_share: float = 0.5) -> DataFrame:
    """Drop documents without a language: no letter, or no language with ``least_share`` of the text (0 keeps all mixtures).

    Null and empty texts have no letter and go.  Each row is judged by itself, so
    repeated rows and ids and null ids go or stay alike; a very long text is judged
    whole; if no row has a language to learn from, all go; an empty table stays empty.
    All columns are handed on, whatever their names.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    kept = language_id.predict(docs, model, keep=tuple(docs.columns)).where((F.col("lang_pred") != "und") & (F.col("score") >= least_share))
    return kept.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines, and documents of which nothing is left.

    Of a line and those within one word edit of it the one in the smallest (id, line)
    stays.  Rows that repeat an id drop the same lines; rows without id keep all theirs;
    a text without words stays as it is, null as the empty text; n_chars is counted
    anew; an empty table stays empty.  All other columns are handed on.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cleaned = line_dedup.line_dedup(docs, keep=others).where("n_dropped = 0 OR trim(text) <> ''")
    return cleaned.select("doc_id", "text", *(F.col(f"kept_{c}").alias(c) for c in others), F.length("text").cast("long").alias("n_chars")).select(*docs.columns)


def row_key(docs: DataFrame) -> Column:
    """A name for each row: its id, rows without id last, and two hashes of all its columns.

    Only rows that are equal in every column share it; it is never null and orders rows by id.
    """
    cells = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(7), *cells).alias("h2"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, keep one row: the one with the smallest id.

    Rows are judged, not ids.  A row without id takes part like any other but
    comes after all that have one: it stays if its class holds no row with an id,
    and a class of such rows alone keeps one.  Rows that repeat an id are rows of
    their own with the classes of their own texts; where a class holds several
    with its smallest id, one stays, chosen by a hash of all columns.  Rows equal
    in every column are one.  Texts without words are like no other and stay.
    """
    keyed = docs.withColumn("row_key", row_key(docs))
    kept = ngram_jaccard.ngram_jaccard(keyed, id_col="row_key").where("component_id = row_key").select("row_key").distinct()
    return keyed.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a window of a benchmark item, each by its own text, with or without id.

    Null and empty texts hold none and stay, as do all rows if there are no items;
    rows equal in every column go or stay together; an empty table stays empty.
    """
    keyed = docs.withColumn("row_key", row_key(docs))
    hit = decontaminate.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_key").where("contaminated").select("row_key")
    return keyed.join(hit, "row_key", "left_anti").select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of what is left, with digests of the ids and of the bytes decoded from them.

    A row for each row: null and empty texts have no tokens, null and repeated ids are
    handed on, long texts are encoded by piece, an empty table stays empty.
    """
    import public_tokenizers

    return bpe.bpe_codec(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", encoding_stage),
]
#: The language model and the token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
