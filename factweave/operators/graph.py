"""Operators over a property graph: nodes (id, label, name) and edges (src, dst, type, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.store import kept


def label_counts(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes of each label; labels without nodes count 0."""
    every = nodes.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return every.join(nodes.groupBy("label").count(), "label", "left").select("label", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: a, b, type."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").union(edges.select("dst", "src", "type"))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str, skip: tuple[str, ...] = ("HAS_CHUNK", "CONTAINS_IMAGE"), limit: int | None = 40) -> DataFrame:
    """Nodes one step from a node, in either direction, by label and name: the first ``limit``, or all."""
    near = undirected(edges.where(((F.col("src") == node) | (F.col("dst") == node)) & ~F.col("type").isin(*skip))).where(F.col("a") == node).select(F.col("b").alias("id")).distinct()
    found = nodes.join(near, "id").orderBy("label", "name", "id")
    return found if limit is None else found.limit(limit)


def reach(edges: DataFrame, seeds: DataFrame, hops: int, keep: Column | None = None) -> DataFrame:
    """Nodes within ``hops`` undirected steps of the seeds (id), with their distance.

    Each step joins only the frontier to the edges and is written to the shared
    folder, as is the result, so a further hop adds one join to the work and none to the plans.
    """
    both = undirected(edges if keep is None else edges.where(keep)).select("a", "b")
    found = front = kept(seeds.select("id", F.lit(0).alias("distance")).distinct())
    for step in range(1, hops + 1):
        near = both.join(front.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        front = kept(near.join(found.select("id"), "id", "left_anti").select("id", F.lit(step).alias("distance")))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def nearest(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """For each node within ``hops`` undirected steps the seed (id) that is nearest, the smaller id first: id, seed, distance."""
    both = undirected(edges).select("a", "b")
    found = front = kept(seeds.select("id", F.col("id").alias("seed"), F.lit(0).alias("distance")).distinct())
    for step in range(1, hops + 1):
        near = both.join(front.select(F.col("id").alias("a"), "seed"), "a").groupBy(F.col("b").alias("id")).agg(F.min("seed").alias("seed"))
        front = kept(near.join(found.select("id"), "id", "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        found = found.union(front)
    return found


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct edges (src, dst, type) with both ends among the ids."""
    inside = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.select("src", "dst", "type").distinct()


def document_members(edges: DataFrame, documents: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """Nodes of each document: linked directly, or through an experiment described in it: document, id.

    What experiments bring along may be given as ``described`` (document, ids), then edges are those of documents alone.
    """
    docs = documents.select(F.col("id").alias("document"))
    direct = undirected(edges.where("type <> 'MEASURED'")).select(F.col("a").alias("document"), F.col("b").alias("id"))
    if described is not None:
        chained = described.select("document", F.explode("ids").alias("id"))
        return direct.union(chained).join(docs, "document", "left_semi").distinct()
    direct = direct.join(docs, "document")
    described = edges.where("type = 'DESCRIBED_IN'").join(docs, F.col("dst") == F.col("document")).select("document", F.col("src").alias("experiment"))
    chained = edges.where("type <> 'DESCRIBED_IN'").join(described, F.col("src") == F.col("experiment")).select("document", F.col("dst").alias("id"))
    return direct.union(chained).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def shortest_paths(edges: DataFrame, source: str, targets: DataFrame, most: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """The shortest undirected path of up to ``most`` steps from a node to each target (id), through allowed nodes only: id, distance, path.

    A node keeps one path, the first by the order of its nodes.
    """
    both = undirected(edges).select("a", "b")
    found = front = kept(edges.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit(0).alias("distance"), F.array(F.lit(source)).alias("path")))
    front = _within(front, allowed)
    for step in range(1, most + 1):
        near = both.join(front.select(F.col("id").alias("a"), "path"), "a").groupBy(F.col("b").alias("id")).agg(F.min("path").alias("path"))
        fresh = near.join(found.select("id"), "id", "left_anti")
        front = kept(_within(fresh.select("id", F.lit(step).alias("distance"), F.concat("path", F.array("id")).alias("path")), allowed))
        if front.isEmpty():
            break
        found = found.union(front)
    return found.join(targets.select("id").distinct(), "id")


def _within(front: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """The rows of a frontier that are allowed nodes (id): the nodes meet the few of the frontier, not the edges."""
    if allowed is None:
        return front
    front = kept(front)
    inside = kept(allowed.select("id").join(kept(front.select("id").distinct()), "id", "left_semi").distinct())
    return front.join(inside, "id", "left_semi")


def paths_between(edges: DataFrame, ends: DataFrame, most: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """The shortest undirected path of up to ``most`` steps between any two of a few nodes (id), through allowed nodes only: a, b, path, with a < b.

    All searches take their steps together, and end when every pair is joined or nothing new is reached; a node
    keeps one path from each start, the first by the order of its nodes.  Whether a step would reach another
    start is read off the edges of the starts, so that the last step is taken to those alone.
    """
    both = undirected(edges).select("a", "b")
    starts = kept(ends.select("id").distinct())
    n = starts.count()
    allowed = None if allowed is None else allowed.select("id").union(starts)
    last = kept(both.join(starts.select(F.col("id").alias("b")), "b", "left_semi").distinct())
    found = front = kept(starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path")))
    met = None

    def step(along: DataFrame, known: DataFrame) -> DataFrame:
        near = along.join(front.select("start", F.col("id").alias("a"), "path"), "a").groupBy("start", F.col("b").alias("id")).agg(F.min("path").alias("path"))
        return near.join(known.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.concat("path", F.array("id")).alias("path"))

    for taken in range(1, most + 1):
        fresh = kept(step(last, found if met is None else found.union(met)).where("start < id"))
        met = fresh if met is None else met.union(fresh)
        if taken == most or met.count() == n * (n - 1) // 2:
            break
        front = kept(_within(step(both, found), allowed))
        if front.isEmpty():
            break
        found = found.union(front)
    empty = starts.where("false").select(F.col("id").alias("start"), "id", F.array("id").alias("path"))
    return (empty if met is None else met).select(F.col("start").alias("a"), F.col("id").alias("b"), "path")


def components(edges: DataFrame) -> DataFrame:
    """Each node of an edge table (a, b) with the smallest node that it is connected to: id, component.

    Large and small stars in turn: a node hands its larger neighbours to its smallest one, then its smaller
    ones; in rounds of a logarithmic number every node hangs on its component's smallest.
    Minima are combined before the shuffle, and nothing but counts comes to the driver.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = kept(pairs), None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        pairs = kept(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())


def merge_snapshots(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Union of two snapshots; a row of the right one replaces the left one's with the same key."""
    return left.join(right, key, "left_anti").unionByName(right)


def canonical_groups(nodes: DataFrame, edges: DataFrame, key: str = "canonical_key") -> DataFrame:
    """Nodes with their keeper: of each key the node with the largest degree, then the smallest id."""
    ranked = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    keeper = ranked.groupBy(key).agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("id").alias("id"))).alias("k"))
    return ranked.join(keeper, key).select("id", F.col("k.id").alias("keeper"))


def redirect(edges: DataFrame, keepers: DataFrame, ends: dict[str, tuple[str, str]] | None = None, once: DataFrame | None = None) -> DataFrame:
    """Edges with merged nodes replaced by their keeper; loops go, repeats become one.

    With the labels of the two ends of each type (``ends``), and keepers that have a label, an end meets the keepers
    of its label alone, and edges whose ends have no keepers meet none; of those that are in ``once``, each once already, none meets another either.
    """
    columns = ["src", "dst", "type", "value"]
    # Most nodes keep themselves.
    moved = keepers.where("id <> keeper")
    if ends is None:
        return _moved(edges, moved, moved).where("src <> dst").select(*columns).distinct()
    moved = kept(moved.select("id", "keeper", "label"), "label")
    labels = {r.label for r in moved.select("label").distinct().collect()}
    of = lambda label: moved.where(F.col("label") == label) if label in labels else None
    touched = [t for t, pair in ends.items() if labels & set(pair)]
    rest = edges.where(~F.col("type").isin(*touched)).where("src <> dst").select(*columns).distinct() if once is None else once.where(~F.col("type").isin(*touched)).where("src <> dst").select(*columns)
    for kind in touched:
        rest = rest.union(_moved(edges.where(F.col("type") == kind), *map(of, ends[kind])).where("src <> dst").select(*columns).distinct())
    return rest


def _moved(edges: DataFrame, *moved: DataFrame | None) -> DataFrame:
    for end, names in zip(("src", "dst"), moved):
        if names is not None:
            names = names.select(F.col("id").alias(end), F.col("keeper").alias(f"{end}_k"))
            edges = edges.join(names, end, "left").withColumn(end, F.coalesce(f"{end}_k", end)).drop(f"{end}_k")
    return edges


def untouched(edges: DataFrame, gone: DataFrame, ends: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Edges without those that touch some nodes (gone: id); if it is known which types start from such nodes and which lead to them (ends), others meet none."""
    left = edges
    for i, end in enumerate(("src", "dst")):
        names = gone.select(F.col("id").alias(end))
        if ends is None:
            left = left.join(names, end, "left_anti").select(*edges.columns)
        else:
            left = left.where(~F.col("type").isin(*ends[i])).union(left.where(F.col("type").isin(*ends[i])).join(names, end, "left_anti").select(*edges.columns))
    return left


#: Edges by which a document owns a node: type, whether the document is its source.
OWNED = {"MENTIONS_MATERIAL": True, "DESCRIBES_PROCESS": True, "MENTIONS_EQUIPMENT": True, "FROM_FACILITY": True, "AUTHORED_BY": True, "AUTHORED": False}
#: Edges to what belongs to one document alone.
PARTS = ("HAS_CHUNK", "HAS_FIGURES", "CONTAINS_IMAGE")


def cascade_delete(nodes: DataFrame, edges: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Delete a document with the experiments described in it, what it alone owns (see OWNED), and its chunks, galleries and images.

    A node is owned by the documents that mention, describe or author it; other edges of it do not keep it.
    """
    described = edges.where((F.col("type") == "DESCRIBED_IN") & (F.col("dst") == document)).select(F.col("src").alias("id"))
    owner = F.when(F.col("type").isin(*(t for t, out in OWNED.items() if out)), F.struct(F.col("src").alias("owner"), F.col("dst").alias("id"))).otherwise(F.struct(F.col("dst").alias("owner"), F.col("src").alias("id")))
    owned = edges.where(F.col("type").isin(*OWNED)).select(owner.alias("o")).select("o.*")
    mine = owned.where(F.col("owner") == document).select("id").distinct()
    alone = mine.join(owned.where(F.col("owner") != document).select("id"), "id", "left_anti")
    parts = edges.where(F.col("type").isin(*PARTS) & (F.col("src") == document)).select(F.col("dst").alias("id"))
    inner = edges.where("type = 'CONTAINS_IMAGE'").join(parts.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    gone = kept(described.union(alone).union(parts).union(inner).union(nodes.sparkSession.range(1).select(F.lit(document).alias("id"))).distinct())
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left.select(*edges.columns)


#: What keeps nodes of a label alive: an edge of one of the types, that ends in the node (in) or starts from it (out).
ALIVE = {
    "Material": [("in", "MENTIONS_MATERIAL")],
    "Experiment": [("out", "DESCRIBED_IN")],
    "Process": [("in", "DESCRIBES_PROCESS"), ("in", "USES_PROCESS"), ("in", "PROCESSED_IN")],
    "Team": [("out", "AUTHORED")],
    "Expert": [("in", "AUTHORED_BY"), ("out", "MEMBER_OF")],
    "Equipment": [("in", "MENTIONS_EQUIPMENT"), ("in", "USES_EQUIPMENT")],
    "Facility": [("in", "FROM_FACILITY"), ("in", "REFERENCES")],
    "Property": [("in", "HAS_PROPERTY"), ("in", "MEASURED"), ("in", "HAS_VALUE")],
    "PropertyValue": [("in", "HAS_VALUE")],
    "RegimeParameter": [("in", "HAS_REGIME_PARAM"), ("in", "HAS_TOPIC")],
    "FigureGallery": [("in", "HAS_FIGURES")],
    "Image": [("in", "CONTAINS_IMAGE")],
    "DocumentChunk": [("in", "HAS_CHUNK")],
}


def orphans(nodes: DataFrame, edges: DataFrame, rules: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Nodes that nothing keeps alive (see ALIVE); a material lives by a described experiment that uses it too, an expert by a team that wrote a document."""
    rules = ALIVE if rules is None else rules
    judged = nodes.where(F.col("label").isin(*rules))
    by: dict[str, list[str]] = {}
    for label, ways in rules.items():
        for end, kind in ways:
            if (label, kind) != ("Expert", "MEMBER_OF"):
                by.setdefault(f"{end}:{kind}", []).append(label)
    # Only the end that counts is looked at, of the types that count for it, each node once.
    labels = F.create_map(*(x for way, names in by.items() for x in (F.lit(way), F.array(*map(F.lit, names))))) if by else F.lit(None).cast("map<string,array<string>>")
    end = lambda name, column: F.struct(labels[F.concat(F.lit(f"{name}:"), "type")].alias("labels"), F.col(column).alias("id"))
    ends = edges.select(F.explode(F.array(end("out", "src"), end("in", "dst"))).alias("e")).where("e.labels IS NOT NULL")
    alive = ends.select(F.explode("e.labels").alias("label"), "e.id")
    described = edges.where("type = 'DESCRIBED_IN'").select("src").distinct()
    used = edges.where("type = 'USES_MATERIAL'").join(described, "src", "left_semi").select(F.col("dst").alias("id"))
    writers = edges.where("type = 'AUTHORED'").select(F.col("src").alias("dst")).distinct()
    members = edges.where("type = 'MEMBER_OF'").join(writers, "dst", "left_semi").select(F.col("src").alias("id"))
    for label, kept_by in (("Material", used), ("Expert", members)):
        if label in rules:
            alive = alive.union(kept_by.select(F.lit(label).alias("label"), "id"))
    return judged.join(alive.distinct(), ["label", "id"], "left_anti").select(*nodes.columns)


def purge(nodes: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Delete all nodes of some labels: what is left, and how many of each label went."""
    doomed = F.col("label").isin(*labels)
    return nodes.where(~doomed), nodes.where(doomed).groupBy("label").agg(F.count("*").alias("n"))


def unlinked(edges: DataFrame, document: str, types: tuple[str, ...] = ("AUTHORED_BY", "HAS_TOPIC")) -> DataFrame:
    """Edges without a document's edges of some types, and without the process links of materials that it alone mentions."""
    away = edges.where(~((F.col("src") == document) & F.col("type").isin(*types)))
    mentions = edges.where("type = 'MENTIONS_MATERIAL'")
    own = mentions.where(F.col("src") == document).select("dst").join(mentions.where(F.col("src") != document).select("dst"), "dst", "left_anti").distinct()
    links = away.where("type = 'PROCESSED_IN'").join(own.withColumnRenamed("dst", "src"), "src", "left_anti")
    return away.where("type <> 'PROCESSED_IN'").unionByName(links.select(*edges.columns))


def json_ld(nodes: DataFrame, types: dict[str, str], edges: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Nodes, and edges if given, as JSON-LD entities and relations, each edge once (as they are given, if ``once`` says so): id, entity."""
    kind = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    urn = lambda c: F.concat(F.lit("urn:"), c)
    entity = F.to_json(F.struct(urn("id").alias("@id"), F.coalesce(kind[F.col("label")], F.lit("Thing")).alias("@type"), F.col("name").alias("name")))
    entities = nodes.select("id", entity.alias("entity"))
    if edges is None:
        return entities
    relation = F.to_json(F.struct(urn("src").alias("subject"), F.col("type").alias("predicate"), urn("dst").alias("object")))
    edges = edges.select("src", "type", "dst")
    return entities.union((edges if once else edges.distinct()).select(F.col("src").alias("id"), relation.alias("entity")))


def chain_order(edges: DataFrame, most: int = 24) -> DataFrame:
    """The nodes of a chain of up to ``most`` nodes in order, from the smaller of its two ends: id, place; nothing if no node has one link alone."""
    ends = degrees(edges.select("src", "dst").distinct()).where("degree = 1").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    return reach(edges, ends, most - 1).select("id", F.col("distance").alias("place"))
