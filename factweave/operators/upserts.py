"""Writes with merge semantics: each takes the stored table and the change, and gives the table to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(stored: DataFrame, incoming: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows by key, incoming ones in place of stored ones; of incoming rows with one key the one with the largest ``order``, then the greatest.

    One aggregation with map-side combine over both tables; stored keys are expected to be unique.
    """
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    first = [order, *(c for c in rest if c != order)] if order else rest
    return rows.groupBy(*key).agg(F.max(F.struct("_new", *first)).alias("_m")).select(*key, *(F.col(f"_m.{c}") for c in rest))


def merge_nodes(stored: DataFrame, incoming: DataFrame, key: str, overwrite: list[str], append: list[str], order: str | None = None) -> DataFrame:
    """Nodes by key: ``overwrite`` from the change, array columns of ``append`` joined as a set, the rest kept unless null.

    The rows of the change with one key are one change: its arrays together, and of
    each other column the value with the largest ``order`` (the greatest value
    without one) that is not null.
    """
    fields = [c for c in stored.columns if c != key]

    def one(c: str) -> Column:
        if c in append:
            return F.array_distinct(F.flatten(F.collect_list(c)))
        return F.max(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))

    new = incoming.groupBy(key).agg(*(one(c).alias(f"_{c}") for c in fields))

    def column(c: str) -> Column:
        if c in append:
            none = F.array().cast(stored.schema[c].dataType)
            return F.array_sort(F.array_union(F.coalesce(c, none), F.coalesce(f"_{c}", none))).alias(c)
        return F.coalesce(*((f"_{c}", c) if c in overwrite else (c, f"_{c}"))).alias(c)

    return stored.join(new, key, "full").select(key, *(column(c) for c in fields))


def property_rows(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an upsert of materials (id, properties: name to value) writes beside the nodes: HAS_PROPERTY edges and values by material and property."""
    cells = incoming.select("id", F.explode("properties").alias("name", "value"))
    edges = cells.select(F.col("id").alias("src"), F.concat(F.lit("prop:"), "name").alias("dst"), F.lit("HAS_PROPERTY").alias("type")).distinct()
    values = cells.where("value IS NOT NULL").groupBy(F.concat_ws("_", "id", "name").alias("id")).agg(F.max("value").alias("value"))
    return edges, values


def document_upsert(documents: DataFrame, chunks: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (id, title) and chunks (chunk_id, id, chunk_index, text) after a change (id, title, texts): an incoming document takes the place of the stored one with all its chunks; blank texts make none."""
    made = incoming.select("id", F.posexplode("texts").alias("chunk_index", "text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    fresh = made.select(F.concat_ws(":", "id", "chunk_index").alias("chunk_id"), "id", "chunk_index", "text")
    rest = chunks.join(incoming.select("id").distinct(), "id", "left_anti").select("chunk_id", "id", "chunk_index", "text")
    return latest(documents, incoming.select("id", "title"), ["id"]), rest.unionByName(fresh)


def experiment_upsert(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Experiments (id, regime_name, status) and their edges after a change (id, regime_name, material, document, parameters, measured: name to value).

    The status is the parameter of that name, else completed.  Edges: USES_MATERIAL,
    DESCRIBED_IN, HAS_REGIME_PARAM and MEASURED, the last two with their value.
    """
    status = F.coalesce(F.try_element_at("parameters", F.lit("status")), F.lit("completed"))
    nodes = latest(stored, incoming.select("id", "regime_name", status.alias("status")), ["id"])
    edge = lambda dst, kind, value: F.struct(dst.alias("dst"), F.lit(kind).alias("type"), value.cast("string").alias("value"))
    plain = lambda c, kind: F.when(F.col(c).isNotNull(), edge(F.col(c), kind, F.lit(None)))
    cells = lambda c, kind, prefix: F.coalesce(F.transform(F.map_entries(c), lambda e: edge(F.concat(F.lit(prefix), e["key"]), kind, e["value"])), F.array())
    own = F.concat(F.array_compact(F.array(plain("material", "USES_MATERIAL"), plain("document", "DESCRIBED_IN"))), cells("parameters", "HAS_REGIME_PARAM", "param:"), cells("measured", "MEASURED", "prop:"))
    # Dealt out by experiment before they are unfolded: repeated edges lie together.
    edges = incoming.repartition("id").select(F.col("id").alias("src"), F.explode(own).alias("e")).select("src", "e.*")
    return nodes, edges.distinct()


def patch(stored: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Stored rows with the columns of the change where it has a value; unknown keys of the change add nothing."""
    fields = [c for c in change.columns if c != key]
    joined = stored.join(change.select(key, *(F.col(c).alias(f"_{c}") for c in fields)), key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in stored.columns))


def link(edges: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges and the wanted ones whose two ends exist, each once."""
    ids = nodes.select("id")
    known = wanted.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(known.select(*edges.columns)).dropDuplicates()


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those to delete."""
    return rows.join(gone.select(key), key, "left_anti")


def galleries(figures: DataFrame) -> DataFrame:
    """doc_id, image_count and a summary such as "2 plot, 1 table", most frequent first; a storage key counts once.

    Counts come before lists, so a document's images are never gathered; ``gallery_items`` gives them as JSON.
    """
    kinds = figures.select("doc_id", "storage_key", "image_type").dropDuplicates(["doc_id", "storage_key"]).groupBy("doc_id", "image_type").count()
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "image_type"))), lambda x: F.concat_ws(" ", (-x["n"]).cast("string"), x["image_type"]))
    return kinds.groupBy("doc_id").agg(F.sum("count").alias("image_count"), F.array_join(parts, ", ").alias("type_summary"))


def gallery_items(figures: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """A document's figures as JSON, by storage key, each once; galleries of an ``old`` table (doc_id, items_json) stay for other documents: doc_id, items_json."""
    one = figures.dropDuplicates(["doc_id", "storage_key"])
    items = F.to_json(F.array_sort(F.collect_list(F.struct("storage_key", "image_type"))))
    made = one.groupBy("doc_id").agg(items.alias("items_json"))
    return made if old is None else old.join(made, "doc_id", "left_anti").unionByName(made)
