"""Which entities are the same: resolution of new ones, fuzzy groups, merged properties, and how well nodes fit a search."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from factweave.functions import text as T
from factweave.functions import values as V
from factweave.store import kept


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters, by longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _grams(text: Column) -> Column:
    """All runs of one, two and three characters."""
    n = F.length(text)
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def containing(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Pairs (name, id) of asked names and the stored entities (id, name, aliases) whose name or alias holds them.

    An equi-join: a text that holds a name holds its first three characters.
    """
    texts = stored.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("t")).select("id", F.lower("t").alias("t"))
    grams = texts.select("id", "t", F.explode(_grams(F.col("t"))).alias("gram"))
    names = asked.select("name").distinct().withColumn("low", F.lower("name")).where("low <> ''").withColumn("gram", F.substring("low", 1, 3))
    return names.join(grams, "gram").where(F.contains("t", F.col("low"))).select("name", "id").distinct()


def resolve(incoming: DataFrame, stored: DataFrame, least: float = 0.85) -> DataFrame:
    """For each incoming entity (name, aliases) the stored one (id, name, aliases, canonical_key) that it is: name, id, how.

    By canonical key; then among the stored ones whose name or alias holds the name:
    the same key, an alias in common, or a similarity over ``least``; else it is new (id null).
    The smallest id of the first way counts.
    """
    asked = incoming.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("aliases", F.lower)))).alias("new_aliases")).withColumn("key", T.canonical_key(F.col("name")))
    by_key = asked.join(stored.select(F.col("canonical_key").alias("key"), "id").where("key <> ''"), "key").select("name", "id", F.lit(0).alias("rank"))
    near = containing(asked, stored).join(asked, "name").join(stored.select("id", F.col("name").alias("other"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower).alias("old_aliases")), "id")
    other_key = T.canonical_key(F.col("other"))
    alias = F.arrays_overlap("new_aliases", "old_aliases") | F.array_contains("old_aliases", F.lower("name")) | F.array_contains("new_aliases", F.lower("other"))
    ranked = near.withColumn("ratio", similarity(F.col("key"), other_key)).withColumn("rank", F.when(F.col("key") == other_key, 1).when(F.coalesce(alias, F.lit(False)), 2).when(F.col("ratio") > least, 3))
    best = by_key.unionByName(ranked.where("rank IS NOT NULL").select("name", "id", "rank")).groupBy("name").agg(F.min(F.struct("rank", "id")).alias("b"))
    how = F.when(F.col("b.rank").isNotNull(), F.get(F.array(*map(F.lit, ("canonical", "exact", "alias", "fuzzy"))), F.col("b.rank")))
    return asked.join(best, "name", "left").select("name", F.col("b.id").alias("id"), F.coalesce(how, F.lit("new")).alias("how"))


def fuzzy_pairs(nodes: DataFrame, least: float = 0.96, reach: int = 39) -> DataFrame:
    """Pairs of nodes (id, label, name) of a label that stand within ``reach`` places in the order of names and are the same but for spelling: a, b, ratio.

    Names are alike by ``least``, and have one key, or one holds the other, or they
    are alike by 0.985.  Places are met by equal blocks of ``reach`` places, so the join is an equi-join.
    """
    placed = nodes.where(F.trim("name") != "").select("id", "label", F.lower(F.trim("name")).alias("name"), T.canonical_key(F.col("name")).alias("key"))
    # Ranges of the order are numbered by themselves, and then by what is before them (a row for each range), so no task holds a whole label.
    ranges = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(placed.repartitionByRange(ranges, "label", "name", "id").withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("range").count().select("range", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("label", "name", "id"))
    placed = ranged.withColumn("own", own).join(F.broadcast(offsets), "range").withColumn("at", F.col("own") + F.col("before")).drop("own", "before", "range").withColumn("block", F.floor(F.col("at") / reach))
    other = placed.select("label", F.explode(F.array("block", F.col("block") - 1)).alias("block"), F.col("id").alias("b"), F.col("name").alias("other"), F.col("key").alias("other_key"), F.col("at").alias("then"))
    met = placed.join(other, ["label", "block"]).where((F.col("then") > F.col("at")) & (F.col("then") <= F.col("at") + reach))
    # Ratios can not exceed what lengths allow.
    fit = met.where(2 * F.least(F.length("name"), F.length("other")) >= least * (F.length("name") + F.length("other")))
    scored = fit.withColumn("ratio", similarity(F.col("name"), F.col("other"))).where(F.col("ratio") >= least)
    same = (F.col("key") == F.col("other_key")) | F.contains("name", F.col("other")) | F.contains("other", F.col("name")) | (F.col("ratio") >= 0.985)
    return scored.where(same).select(F.col("id").alias("a"), "b", F.round("ratio", 6).alias("ratio"))


def merged_materials(rows: DataFrame) -> DataFrame:
    """Materials of one canonical key (id, name, aliases, material_class, seq) as one: the first id, the last name, all aliases, the most specific class.

    Classes are ordered as in the list of material classes, the last being the most specific.
    """
    rank = T.lookup({c: f"{i:02d}" for i, c in enumerate(V.MATERIAL_CLASSES)}, F.col("material_class"))
    return rows.groupBy("canonical_key").agg(
        F.min_by("id", "seq").alias("id"), F.max_by("name", "seq").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.max_by("material_class", F.struct(F.coalesce(rank, F.lit("")), -F.col("seq"))).alias("material_class"),
    )


def plural_key(name: Column) -> Column:
    """The words of a name in order of the alphabet, without a closing s: names that differ by order or number share it."""
    words = F.filter(F.split(T.plain_name(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w))), " ")


def display_keepers(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Nodes (id, label, name) with the one of the same label and key that is shown for them: the most links, then the longest name, then the smallest id."""
    ranked = nodes.withColumn("key", plural_key(F.col("name"))).where("key <> ''").join(degrees, "id", "left")
    best = F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), (-F.length("name")).alias("n"), F.col("id").alias("id")))
    keeper = ranked.groupBy("label", "key").agg(best.alias("k"))
    return ranked.join(keeper, ["label", "key"]).select("id", F.col("k.id").alias("keeper"))


def measurements(rows: DataFrame) -> DataFrame:
    """Measurements (experiment, property, value, unit, created_at) of which each experiment, property, value and unit stands once, the newest."""
    key = [F.col("experiment"), F.col("property"), T.strip(F.lower("value")).alias("value_key"), T.strip(F.lower(F.coalesce("unit", F.lit("")))).alias("unit_key")]
    return rows.groupBy(*key).agg(F.max_by("value", F.struct("created_at", "value")).alias("value"), F.max("created_at").alias("created_at")).select("experiment", "property", "value", "unit_key", "created_at")


def routed(entities: DataFrame, kind: Column) -> DataFrame:
    """Entities (label, name) under the label that the kind of their name tells, if it tells one: name, label, was.

    ``kind`` is made of name and label alone.  Rows of a run that are the same are judged once and then written as often as
    they were, in as many tasks as a shuffle has; runs keep a name that is everywhere in many of them.
    """
    run = F.shiftright(F.monotonically_increasing_id(), 18)
    each = entities.select("name", "label", run.alias("run")).groupBy("run", "name", "label").agg(F.count(F.lit(1)).alias("n"))
    # Few rows would be put into one task, which then writes all.
    each = each.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run", "name")
    labels = {"organization": "Team", "person": "Expert", "process": "Process", "facility": "Facility", "equipment": "Equipment", "parameter": "RegimeParameter"}
    judged = each.select("name", F.coalesce(T.lookup(labels, kind), F.col("label")).alias("label"), F.col("label").alias("was"), "n")
    return judged.select("name", "label", "was", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")


def node_score(name: Column, hay: Column, label: Column, phrases: list[str], skip: tuple[str, ...] = ("Document", "Team", "Expert")) -> Column:
    """How well a node fits search phrases: 100 for its name, 82 or 78 where one holds the other, 72 or 58 as a word, 48 inside a text; labels add to it, some are held down to 24 unless they reach 70."""
    low, text, best = F.lower(T.strip(name)), F.lower(hay), F.lit(0)
    for phrase in phrases:
        p = " ".join(phrase.lower().split())
        if p:
            word = T.has(text, T.bounded("".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in p)))
            fit = F.when(low == p, 100).when(F.contains(low, F.lit(p)) & F.lit(len(p) >= 5), 82).when(F.contains(F.lit(p), low) & (F.length(low) >= 5), 78)
            best = F.greatest(best, fit.when(word, 72 if len(p) >= 8 else 58).when(F.contains(text, F.lit(p)) & F.lit(len(p) >= 7), 48).otherwise(0))
    bonus = F.when(label == "Property", 8).when(label == "Experiment", 6).when(label == "Material", 4).otherwise(0)
    full = F.when(best > 0, best + bonus).otherwise(0)
    return F.when(label.isin(*skip) & (full < 70), F.least(full, F.lit(24))).otherwise(full)


def search_focus(nodes: DataFrame, phrases: list[str], primary: int = 10, least: int = 42) -> DataFrame:
    """The nodes that fit best: up to ``primary`` of them with ``least`` or more: id, score."""
    scored = nodes.select("id", node_score(F.col("name"), F.col("name"), F.col("label"), phrases).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(primary)
