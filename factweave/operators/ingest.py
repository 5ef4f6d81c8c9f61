"""Chunking, packing and duplicate decisions on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T


def split_long(chunks: DataFrame, size: int) -> DataFrame:
    """Cut chunks every ``size`` characters: chunk_id, part, text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    return chunks.select("chunk_id", "doc_id", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(size)))).alias("part", "text"))


def pack(chunks: DataFrame, target: int = 1400, bypass: int = 0) -> DataFrame:
    """Greedy packs of neighbouring chunks of up to ``target`` characters: doc_id, pack, n_chunks, text, first_chunk.

    Only lengths are folded, and the fold keeps but the numbers of the chunks that
    open a pack: a chunk does that when it does not fit with the two characters
    between chunks.  Texts are joined once, by pack.  A document of up to ``bypass``
    chunks keeps them as they are.
    """
    sizes = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.length("text").alias("size")))).alias("rows"))
    start = F.struct(F.lit(-1).alias("held"), F.lit("").alias("opens"))

    def step(acc: Column, row: Column) -> Column:
        fits = (acc["held"] >= 0) & (acc["held"] + 2 + row["size"] <= target)
        # Openers are gathered in a string, which grows by few bytes a pack.
        opens = F.when(fits, acc["opens"]).otherwise(F.concat(acc["opens"], F.lit(","), row["chunk_index"].cast("string")))
        return F.struct(F.when(fits, acc["held"] + 2 + row["size"]).otherwise(row["size"]).alias("held"), opens.alias("opens"))

    alone = F.transform("rows", lambda r: r["chunk_index"])
    opened = F.transform(F.filter(F.split(F.aggregate("rows", start, step)["opens"], ","), lambda x: x != ""), lambda x: x.cast("int"))
    bounds = sizes.select("doc_id", F.posexplode(F.when(F.size("rows") <= bypass, alone).otherwise(opened)).alias("pack", "opens"))
    opens = chunks.join(bounds.select("doc_id", F.col("opens").alias("chunk_index"), "pack"), ["doc_id", "chunk_index"], "left")
    packed = opens.withColumn("pack", F.last("pack", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return packed.groupBy("doc_id", "pack").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(texts, lambda r: r["text"]), "\n\n").alias("text"), F.min_by("chunk_id", "chunk_index").alias("first_chunk"))


def sample_places(n: Column, points: int = 32) -> Column:
    """Evenly spaced places (from 0) of n rows: the first, the middle and the last, and ``points`` in between."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * n / points).cast("int"))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.floor(n / 2).cast("int"), (n - 1).cast("int")), spread)))


def sampled(chunks: DataFrame, points: int = 32) -> DataFrame:
    """The chunks of each document at evenly spaced places: chunk_id, doc_id, place."""
    by = Window.partitionBy("doc_id")
    placed = chunks.select("chunk_id", "doc_id", (F.row_number().over(by.orderBy("chunk_index")) - 1).alias("place"), F.count("*").over(by).alias("n"))
    return placed.where(F.array_contains(sample_places(F.col("n"), points), F.col("place"))).select("chunk_id", "doc_id", "place")


def sections(chunks: DataFrame, passes: int) -> DataFrame:
    """Chunk i of n belongs to pass floor(i * passes / n)."""
    by = Window.partitionBy("doc_id")
    i = F.row_number().over(by.orderBy("chunk_index")) - 1
    return chunks.select("chunk_id", F.floor(i * passes / F.count("*").over(by)).cast("int").alias("section"))


def within_budget(chunks: DataFrame, budget: int) -> DataFrame:
    """Chunks of each document up to a running number of characters."""
    used = F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("used", used).where(F.col("used") <= budget).select("chunk_id", "used")


def content_hash(chunks: DataFrame) -> DataFrame:
    """sha256 of a document's normalised chunks, joined by line ends: doc_id, content_hash."""
    clean = chunks.select("doc_id", "chunk_index", T.hash_text(F.col("text")).alias("t")).where("t <> ''")
    return clean.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "t"))), lambda r: r["t"]), "\n"), 256).alias("content_hash"))


def duplicate_documents(documents: DataFrame, keys: list[str], id_col: str, by: str) -> DataFrame:
    """Documents that are not the newest of every fingerprint that they have: id.

    Each fingerprint is judged by itself; groups are reduced to their newest row before the join.
    """
    rows = documents.select(id_col, by, F.explode(F.array(*(F.when(F.col(k).isNotNull(), F.concat_ws("=", F.lit(k), F.col(k))) for k in keys))).alias("key")).where("key IS NOT NULL")
    best = rows.groupBy("key").agg(F.max(F.struct(F.col(by), F.col(id_col))).alias("best"))
    return rows.join(best, "key").where(F.col(f"best.{id_col}") != F.col(id_col)).select(id_col).distinct()


def newest(stored: DataFrame, key: str) -> DataFrame:
    """Of the stored documents (id, content_hash, created_at) with one key the newest, then the smallest id: the key, existing_id, existing_hash."""
    rows = stored.select(F.col(key).alias("k"), F.col("id").alias("existing_id"), F.col("content_hash").alias("existing_hash"), "created_at").where("k IS NOT NULL")
    first = rows.groupBy("k", "created_at").agg(F.min(F.struct("existing_id", "existing_hash")).alias("d"))
    return first.groupBy("k").agg(F.max_by("d", F.struct(F.col("created_at").isNotNull(), "created_at")).alias("d")).select(F.col("k").alias(key), "d.*")


def _decided(incoming: DataFrame, stored: DataFrame, ways: list[tuple[str, bool]]) -> DataFrame:
    """The first way (a key; whether changed content replaces) by which a stored document matches decides."""
    out, action, existing = incoming, F.lit("create"), F.lit(None)
    for i, (key, _) in enumerate(ways):
        out = out.join(newest(stored, key).select(F.col(key), F.col("existing_id").alias(f"_id{i}"), F.col("existing_hash").alias(f"_hash{i}")), key, "left")
    for i, (_, replaces) in reversed(list(enumerate(ways))):
        same = F.col(f"_hash{i}").isNull() | (F.col(f"_hash{i}") == F.col("content_hash"))
        met = F.when(same, "skip").otherwise("replace") if replaces else F.lit("skip")
        action, existing = F.when(F.col(f"_id{i}").isNotNull(), met).otherwise(action), F.coalesce(f"_id{i}", existing)
    return out.select("name", action.alias("action"), existing.alias("existing_id"))


def decide(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """create, replace or skip for each incoming page (name, source, content_hash), with the document that it meets.

    A known source comes first: with equal (or unknown) content it skips, else it
    replaces.  Then content that is stored from elsewhere skips; all else creates.
    Of several documents with a key the newest counts.
    """
    return _decided(incoming, stored, [("source", True), ("content_hash", False)])


def decide_file(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The same for a file (name, file_hash, file_path, content_hash): by its bytes (changed content replaces), its name, its content."""
    return _decided(incoming, stored, [("file_hash", True), ("file_path", False), ("content_hash", False)])


def consolidated(matches: DataFrame, key: str) -> DataFrame:
    """Documents that are not the newest of their key: id, keeper."""
    keep = newest(matches, key).select(key, F.col("existing_id").alias("keeper"))
    return matches.join(keep, key).where("id <> keeper").select("id", "keeper").distinct()


def sampled_images(images: DataFrame, pages: int = 48, each: int = 2, most: int = 36, least: int = 2400) -> DataFrame:
    """Images of each document (doc_id, page, size, sha) that stand for it: of ``pages`` evenly spaced pages the ``each`` largest of ``least`` bytes or more, ``most`` a document in the order of pages; a content counts once, at its first place."""
    by_doc, place = Window.partitionBy("doc_id"), lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), "sha"))
    stride = F.greatest(F.lit(1), F.ceil(F.max("page").over(by_doc) / pages))
    held = images.withColumn("stride", stride).where(((F.col("page") - 1) % F.col("stride") == 0) & (F.col("size") >= least))
    first = held.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("page", F.desc("size")))).where("copy = 1")
    top = first.withColumn("place", place("doc_id", "page")).where(F.col("place") <= each)
    kept = top.withColumn("n", F.row_number().over(by_doc.orderBy("page", "place"))).where(F.col("n") <= most)
    return kept.select("doc_id", "page", "size", "sha")
