"""Operator 7: document fingerprints by spot signatures (native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components, held

#: Anchors: common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it its of on or that the their there this to was were will with "
    "au aux ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour qui que se sur un une "
    "als auch auf aus bei das dem den der die ein eine er es für im ist mit nicht oder sich sie sind und von war zu "
    "al como con del el ella los las lo más no para pero por se si sin su sus y"
).split()


def _spots(text: Column, chain: int) -> Column:
    """All spots of a text: each anchor with the content words that follow it, ``chain`` at most; anchors without a content word give none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    anchors = list(dict.fromkeys(ANCHORS))
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(anchors), F.concat(F.lit("\x01"), w)).otherwise(w)), " ")
    runs = F.slice(F.split(marked, " ?\x01"), 2, 1 << 30)  # what stands before the first anchor is no spot
    return F.transform(F.filter(runs, lambda r: r.contains(" ")), lambda r: F.substring_index(r, " ", chain + 1))


def signatures(text: Column, chain: int = 3) -> Column:
    """The spot signature set of a text: sorted distinct 32-bit hashes.

    A text without spots but with words has one signature, of all its words; one without words has none.
    """
    spots = F.array_sort(F.array_distinct(F.transform(_spots(text, chain), lambda s: F.hash(s))))
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    bare = F.when(plain == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(plain)))
    return F.get(F.transform(F.array(spots), lambda s: F.when(F.size(s) > 0, s).otherwise(bare)), F.lit(0))  # a lambda, so that spots is worked out once


def as_text(signature_set: Column) -> Column:
    """A fingerprint as a string: the signatures in order, joined by dots."""
    return F.array_join(signature_set.cast("array<string>"), ".")


def length_partition(size: Column, threshold: float = 0.8) -> Column:
    """Sets whose sizes differ by more than one partition are less alike than ``threshold``."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)))).otherwise(-1).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike (1), an empty and another one are not (0, without a comparison)."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _named(docs: DataFrame, id_col: str, text_col: str, chain: int) -> DataFrame:
    """Rows with an id: id, set, name (a 128-bit hash of the set, in bytes)."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.coalesce(F.col(text_col).cast("string"), F.lit("")), chain).alias("set"))
    return rows.withColumn("name", F.unhex(F.md5(as_text(F.col("set")))))


def _entries(sets: DataFrame, threshold: float) -> DataFrame:
    """Each set (name, set, n) at the rarest of its signatures, of which one is common to any other that is alike: name, n, pos, spot.

    Signatures that stand in one set alone come first in the order and meet nothing: they are counted, not moved.
    """
    spots = sets.select("name", "n", F.explode("set").alias("spot"))
    common = spots.groupBy("spot").count().where("count > 1")
    ranked = spots.join(common, "spot").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("count", "spot"))).alias("order")).withColumn("lone", F.col("n") - F.size("order"))
    room = F.greatest(F.col("n") - _least(threshold, F.col("n")) + 1 - F.col("lone"), F.lit(0))
    return held(ranked.select("name", "n", "lone", F.posexplode(F.slice("order", F.lit(1), room)).alias("pos", "s")).select("name", "n", (F.col("pos") + F.col("lone")).alias("pos"), "s.spot"))


def _least(share: float, n: Column) -> Column:
    return F.ceil(F.lit(share) * n - 1e-9).cast("int")


def _sides(entries: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The entries as the smaller set of a pair, in the partition of its length, and as the larger one, in all that a smaller one can have."""
    n = F.col("n")
    smaller = entries.where(F.col("pos") <= n - _least(2 * threshold / (1 + threshold), n)).withColumn("part", length_partition(n, threshold))
    reach = F.sequence(length_partition(F.greatest(_least(threshold, n), F.lit(1)), threshold), length_partition(n, threshold))
    return smaller, entries.withColumn("part", F.explode(reach))


def _met(smaller: DataFrame, larger: DataFrame, threshold: float, block: int, other: Column | None = None) -> DataFrame:
    """Pairs of names (x, y) that meet in a list and whose sizes and places allow the likeness; ``other`` (of columns own and own_y) rules out more.

    Lists of more than ``block`` entries are cut into blocks, and all blocks of the two sides meet: no pair is left out.
    """
    blocks = lambda df, c: df.groupBy("spot", "part").agg(F.ceil(F.count("*") / block).cast("int").alias(c))
    # Only lists that both sides have, and that are long on one, are cut.
    cut = held(blocks(smaller, "u").join(blocks(larger, "v"), ["spot", "part"]).where("u > 1 OR v > 1"))
    salted = lambda df, own: df.join(cut, ["spot", "part"], "left").withColumn(own, F.pmod(F.xxhash64("name"), F.coalesce(own, F.lit(1))).cast("int"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    more = ["own"] if other is not None else []
    left = salted(smaller, "u").withColumn("v", every("v")).select("spot", "part", "u", "v", F.col("name").alias("x"), "n", "pos", *more)
    right = salted(larger, "v").withColumn("u", every("u")).select("spot", "part", "u", "v", F.col("name").alias("y"), F.col("n").alias("m"), F.col("pos").alias("at"), *(F.col(c).alias(f"{c}_y") for c in more))

    n, m = F.col("n"), F.col("m")
    order = (n < m) | ((n == m) & (F.col("x") < F.col("y")))
    room = (1 + threshold) * F.least(n - F.col("pos"), m - F.col("at")) >= threshold * (n + m) - 1e-6
    fit = order & (n >= threshold * m - 1e-9) & room
    return held(left.join(right, ["spot", "part", "u", "v"]).where(fit if other is None else fit & other).select("x", "y").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) that are alike by ``threshold`` or more, with their likeness."""
    both = pairs.join(sets.select(F.col("name").alias("x"), F.col("set").alias("s")), "x").join(sets.select(F.col("name").alias("y"), F.col("set").alias("t")), "y")
    return both.select("x", "y", likeness(F.col("s"), F.col("t")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-9)


def _alike(sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs (x, y: names, likeness) of the distinct ``sets`` (name, set, n) that are alike by ``threshold`` or more.

    The smaller set of a pair (by size, then name) meets the larger one at a
    signature that both have among the rarest ones of which one must be common,
    in a partition that holds the smaller one's length.  Sizes and the place of
    the signature prune each pair.
    """
    sets = sets.where("n > 0")
    return _verified(_met(*_sides(_entries(sets, threshold), threshold), threshold, block), sets, threshold)


def _classes(sets: DataFrame, threshold: float, block: int, turns: int) -> DataFrame:
    """The component of each of the ``sets`` (name, set, n) that is alike to another: node, component (names).

    First each entry of a list is held against the one before it, in ``turns`` random orders within blocks of
    the list: a number of pairs in proportion to the entries, which ties a group of near copies together.
    Then only sets of different components still meet, in the lists that hold several, as in ``_alike``:
    what is alike across components is found there, so no link that ties two of them is lost.
    """
    sets = sets.where("n > 0")
    entries = _entries(sets, threshold)
    smaller, larger = _sides(entries, threshold)
    parts = smaller.join(smaller.groupBy("spot", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("u")).where("u > 1"), ["spot", "part"], "left")
    edges = None
    for turn in range(turns):
        salt = F.pmod(F.xxhash64(F.lit(turn), "name"), F.coalesce("u", F.lit(1)))
        before = F.lag("name").over(Window.partitionBy("spot", "part", "salt").orderBy(F.xxhash64(F.lit(turn + turns), "name"), "name"))
        chained = parts.withColumn("salt", salt).select(before.alias("x"), F.col("name").alias("y")).where("x IS NOT NULL")
        tied = held(_verified(chained.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), sets, threshold).select("x", "y"))
        edges = tied if edges is None else edges.union(tied)
    known = components(edges, a="x", b="y").select(F.col("node").alias("name"), "component")
    owned = held(entries.join(known, "name", "left").withColumn("own", F.coalesce("component", "name")).drop("component"))
    smaller, larger = _sides(owned, threshold)
    several = held(larger.groupBy("spot", "part").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("spot", "part"))  # the larger side holds the smaller one
    inside = lambda df: df.join(several, ["spot", "part"], "left_semi")
    across = _verified(_met(inside(smaller), inside(larger), threshold, block, F.col("own") != F.col("own_y")), sets, threshold)
    return components(held(edges.union(across.select("x", "y"))), a="x", b="y")


def fingerprint_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 3, block: int = 1000, turns: int = 3) -> DataFrame:
    """Near duplicates by fingerprint: a row for each document, with its class.

    ``representative`` is the smallest id with the same fingerprint, ``component_id`` the smallest id that can
    be reached over fingerprints that are alike by ``threshold`` or more.  Documents with one fingerprint
    are one node, and pairs within a component that is known already are not looked at (see ``_classes``),
    so a group of near copies costs in proportion to its size.

    Null text is empty; all texts without words have one fingerprint and are alike to nothing else; rows without
    id are left out, as they cannot be named; rows that repeat an id each have their own fingerprint and row; an
    empty table gives no rows; a very long text is one row's work; ties go to the smaller id; other columns are not looked at,
    whatever their names.  Columns: id, representative, component_id.
    """
    named = held(_named(docs, id_col, text_col, chain))
    sets = held(named.groupBy("name").agg(F.min("id").alias("first"), F.any_value("set").alias("set")).withColumn("n", F.size("set")))
    tied = _classes(sets, threshold, block, turns).select(F.col("node").alias("name"), "component")
    own = held(sets.select("name", "first").join(tied, "name", "left").withColumn("component", F.coalesce("component", "name")))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = own.join(least, "component").select("name", F.col("first").alias("representative"), "component_id")
    return named.select("name", F.col("id").alias(id_col)).join(classes, "name").select(id_col, "representative", "component_id")


def fingerprint_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 3, block: int = 1000) -> DataFrame:
    """All pairs that are alike by ``threshold`` or more, for small selections (fingerprint_classes is for corpora): a, b, likeness, kind.

    Kind "equal": b is a row whose fingerprint equals that of a, the smallest id
    that has it (a row for each row, that of the smallest id itself included, with
    likeness 1).  Kind "alike": a < b are the smallest ids of two different
    fingerprints that are alike.  Two documents are alike if their smallest ids are
    the same or a pair.  All texts without words have one fingerprint, the empty set.

    Rows without id are left out, as they cannot be named; rows that repeat an id
    each have their own fingerprint, so ids of a pair may be the same; an empty
    table gives no rows.  The pairs within a group of near copies grow with the
    square of its size.
    """
    named = held(_named(docs, id_col, text_col, chain))
    sets = held(named.groupBy("name").agg(F.min("id").alias("id"), F.any_value("set").alias("set")).withColumn("n", F.size("set")))
    ids = sets.select("name", "id")
    equal = named.select("name", F.col("id").alias("b")).join(ids, "name").select(F.col("id").alias("a"), "b", F.lit(1.0).alias("likeness"), F.lit("equal").alias("kind"))
    met = _alike(sets, threshold, block).join(ids.select(F.col("name").alias("x"), F.col("id").alias("i")), "x").join(ids.select(F.col("name").alias("y"), F.col("id").alias("j")), "y")
    return equal.unionByName(met.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "likeness", F.lit("alike").alias("kind")))


def similar_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = 3) -> DataFrame:
    """The pairs of different fingerprints alone (see fingerprint_links): a, b, likeness."""
    return fingerprint_links(docs, id_col=id_col, text_col=text_col, threshold=threshold, chain=chain).where("kind = 'alike'").drop("kind")


def neighbours(ids: DataFrame, per_range: int = 100_000) -> DataFrame:
    """For each distinct id (with n) its next id, its previous id and the n of that, in a circle: id, next, prev, prev_n.

    Spark deals the ids out over ranges, about ``per_range`` to each and as many ranges
    as the session's shuffles have partitions at least; each range is ordered by itself, and the
    ends of the ranges (one row each) are joined to one another.  Ids of any type
    that has an order will do.
    """
    spark = ids.sparkSession
    ids = held(ids.where("id IS NOT NULL").groupBy("id").agg(F.max("n").alias("n")))
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // per_range))
    ranged = held(ids.repartitionByRange(pieces, "id").withColumn("range", F.spark_partition_id()))
    order = Window.partitionBy("range").orderBy("id")
    placed = ranged.select("id", "n", "range", F.lead("id").over(order).alias("next"), F.lag(F.struct("id", "n")).over(order).alias("prev"))
    ends = ranged.groupBy("range").agg(F.min("id").alias("first"), F.max(F.struct("id", "n")).alias("last"))  # as many rows as ranges
    circle = Window.orderBy("range")
    lone = Window.partitionBy(F.lit(0))
    ends = ends.select("range", F.coalesce(F.lead("first").over(circle), F.min("first").over(lone)).alias("first"), F.coalesce(F.lag("last").over(circle), F.max("last").over(lone)).alias("last"))
    joined = placed.join(F.broadcast(ends), "range")
    before = F.coalesce("prev", "last")
    return joined.select("id", F.coalesce("next", "first").alias("next"), before["id"].alias("prev"), before["n"].alias("prev_n"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chain: int = 3) -> DataFrame:
    """Fingerprint of each text, of the text with its last quarter replaced by the beginning of the next document, and how alike they and the next one are.

    Only the part of a text that the previous document takes and its signatures go to
    that document; every whole text is shuffled once, by id (both joins read one exchange).

    Null text is empty; the next document of the last is the first, of a lone
    one itself; rows that repeat an id each give a row, and their smallest text is
    their neighbours' next; rows without id have no place in the order and are left
    out; ids may be of any type with an order; an empty table gives no rows; a very
    long text is worked off by one task; other columns are not
    looked at, whatever their names.  Columns: id, n_chars, edited, fingerprint, edited_fingerprint
    (arrays of signatures), near_edited, near_next, length_partition.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL")
    order = held(neighbours(texts.select("id", F.length("text").alias("n"))))
    heads = texts.join(order.hint("merge"), "id").select(
        F.col("prev").alias("id"), F.col("text").substr(F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"), signatures(F.col("text"), chain).alias("next_set")
    )
    heads = heads.groupBy("id").agg(F.min(F.struct("head", "next_set")).alias("h"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    head = F.col("h.head")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(head, F.lit(1), quarter))
    whole = texts.join(heads.hint("merge"), "id").select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), signatures(F.col("text"), chain).alias("fingerprint"), F.col("h.next_set").alias("next_set"))
    # The generator keeps each signature set from being worked out again for each use.
    made = whole.select("*", F.explode(F.array(F.struct(F.col("fingerprint").alias("own"), signatures(F.col("edited"), chain).alias("new")))).alias("s"))
    return made.select(
        F.col("id").alias(id_col), "n_chars", "edited", F.col("s.own").alias("fingerprint"), F.col("s.new").alias("edited_fingerprint"),
        likeness(F.col("s.own"), F.col("s.new")).alias("near_edited"), likeness(F.col("s.own"), F.col("next_set")).alias("near_next"), length_partition(F.size("s.own")).alias("length_partition"),
    )


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", "length_partition")


def op7_spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_spotsigs": op7_spotsigs, "op7_spotsigs_links": op7_spotsigs_links}
ORACLE_SQL: dict[str, str] = {}
