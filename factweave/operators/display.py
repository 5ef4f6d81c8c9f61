"""What a graph view shows: merged names, a search's surroundings, pages of entities, opened documents, removed ones, and kinds of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.functions import values as V
from factweave.operators import graph
from factweave.operators.entities import node_score
from factweave.store import kept

# Merged names ------------------------------------------------------------------------------------


def _words(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(T.plain_name(name), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: F.length(w) > 1)


def token_key(name: Column) -> Column:
    """The words of a name of two characters or more in the order of the alphabet; without any the plain name."""
    return T.bind(_words(name), lambda w: F.when(F.size(w) == 0, F.regexp_replace(T.strip(F.regexp_replace(T.plain_name(name), r"[^\p{L}\p{N}\s]", " ")), r"\s+", "_")).otherwise(F.array_join(F.array_sort(w), "_")))


def base_label(name: Column) -> Column:
    """A property's name without the number that follows it."""
    return T.strip(F.regexp_replace(name, r"(?i):\s*[-+]?[\d.,]+.*$", ""))


def shown_key(label: Column, name: Column) -> Column:
    """The key under which names of a label are one: the glossary's, else letters, digits and underscores, else the words in order."""
    plain = T.plain_name(F.when(label == "Property", base_label(name)).otherwise(T.strip(name)))
    compact = T.strip(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    known = F.coalesce(T.lookup(T.GLOSSARY_FORMS, plain), T.lookup(T.GLOSSARY_FORMS, compact))
    return F.coalesce(known, F.nullif(F.regexp_replace(compact, r"\s+", "_"), F.lit("")), F.nullif(token_key(name), F.lit("")))


def _held(keys: DataFrame) -> DataFrame:
    """Keys (label, key, size, words) that hold another one of their label, with each of those: label, key, by (size, key).

    A key meets by its whole text: of the longer ones the parts that are as long as some key
    of the label are cut out, so a beginning that many keys share brings nothing together.
    """
    sizes = keys.groupBy("label").agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.substring(F.col("key"), i, n))
    cut = F.array_distinct(F.flatten(F.transform(F.filter("sizes", lambda n: n < F.col("size")), parts)))
    long = keys.join(F.broadcast(sizes), "label").select("label", "key", F.col("words").alias("b"), F.explode(cut).alias("short"))
    short = keys.select("label", F.col("key").alias("short"), F.struct("size", "key").alias("by"), F.col("words").alias("a"))
    return long.join(short, ["label", "short"]).where(F.contains("a", F.col("b")) | F.contains("b", F.col("a"))).select("label", "key", "by")


def shown_keepers(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = V.MERGED_LABELS) -> DataFrame:
    """Nodes (id, label, name) of the labels with the node that is shown for them: id, keeper, root, label.

    Names of one key are one.  Of keys of a label of which one holds the other (and whose shown names' words do), the
    shorter takes in the longer, which then takes in nothing itself: keys are decided from the shortest on,
    each as soon as all that it holds are, a round for all of them at once.  A key is
    looked for among the parts of the longer ones.  The shown node has most links, then the longest name, then the smallest id; names of a key are judged by its own shown node.
    """
    ranked = nodes.where(F.col("label").isin(*labels)).select("id", "label", F.coalesce("name", F.lit("")).alias("name")).withColumn("key", shown_key(F.col("label"), F.col("name"))).where("key IS NOT NULL")
    ranked = kept(ranked.join(graph.degrees(edges), "id", "left").select("id", "label", "name", "key", F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), (-F.length("name")).alias("n"), F.col("id").alias("id")).alias("rank")))
    keys = kept(ranked.groupBy("label", "key").agg(F.min_by("name", "rank").alias("name")).withColumn("words", token_key(F.col("name"))).withColumn("size", F.length("key")))
    pairs = kept(_held(keys))

    roots = kept(keys.select("label", "key").join(pairs.select("label", "key").distinct(), ["label", "key"], "left_anti"))
    gone, open_ = None, kept(pairs.select("label", "key").distinct())
    while not open_.isEmpty():
        known = roots.select("label", F.col("key").alias("other"), F.lit(1).alias("state"))
        known = known if gone is None else known.union(gone.select("label", F.col("key").alias("other"), F.lit(0).alias("state")))
        judged = pairs.join(open_, ["label", "key"], "left_semi").withColumn("other", F.col("by.key")).join(known, ["label", "other"], "left").groupBy("label", "key").agg(F.max("state").alias("state"), F.count_if(F.col("state").isNull()).alias("open"))
        judged = kept(judged.select("label", "key", F.when(F.col("state") == 1, 0).when(F.col("open") == 0, 1).alias("state")))
        roots = roots.union(judged.where("state = 1").select("label", "key"))
        absorbed = judged.where("state = 0").select("label", "key")
        gone = absorbed if gone is None else gone.union(absorbed)
        open_ = kept(judged.where("state IS NULL").select("label", "key"))
    into = pairs.withColumn("other", F.col("by.key")).join(roots.select("label", F.col("key").alias("other")), ["label", "other"], "left_semi").groupBy("label", "key").agg(F.min("by").alias("by"))
    rooted = ranked.join(into if gone is None else into.join(gone, ["label", "key"], "left_semi"), ["label", "key"], "left").withColumn("root", F.coalesce("by.key", "key"))
    keeper = rooted.groupBy("label", "root").agg(F.min("rank").alias("k"))
    return rooted.join(keeper, ["label", "root"]).select("id", F.col("k.id").alias("keeper"), "root", "label")


def merged_view(nodes: DataFrame, edges: DataFrame, keepers: DataFrame, ends: dict[str, tuple[str, str]] | None = None, once: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes without those that others are shown for, with the other names as aliases (id, label, name, aliases); and edges between what is left, each once (``ends``, ``once``: see graph.redirect)."""
    names = keepers.where("id <> keeper").join(nodes.select("id", "name"), "id").select(F.col("keeper").alias("id"), "name")
    aliases = names.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("others"))
    left = nodes.join(keepers.where("id <> keeper").select("id"), "id", "left_anti").join(aliases, "id", "left")
    return left.select("id", "label", "name", F.array_remove(F.coalesce("others", F.array().cast("array<string>")), F.col("name")).alias("aliases")), graph.redirect(edges, keepers, ends, once)


def reconciled(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes (id, label, name, canonical_key) with their keeper: those of one label and key, and those of like names (pairs: a, b), are one, over any number of steps: id, keeper.

    The keeper has most links, then the smallest id.
    """
    first = nodes.where("canonical_key <> ''").groupBy("label", "canonical_key").agg(F.min("id").alias("a"))
    same = nodes.where("canonical_key <> ''").join(first, ["label", "canonical_key"]).where("id <> a").select("a", F.col("id").alias("b"))
    tied = graph.components(same.union(pairs.select("a", "b")))
    ranked = nodes.select("id").join(tied, "id", "left").withColumn("component", F.coalesce("component", "id")).join(graph.degrees(edges), "id", "left").withColumn("rank", F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.col("id").alias("id")))
    keeper = ranked.groupBy("component").agg(F.min("rank").alias("k"))
    return ranked.join(keeper, "component").select("id", F.col("k.id").alias("keeper"))


def united_values(edges: DataFrame, keepers: DataFrame, kind: str = "HAS_PROPERTY") -> DataFrame:
    """The property values of merged nodes as those of their keeper; of a property that several have the keeper's own counts, else the first by id: id, property, value."""
    own = edges.where(F.col("type") == kind).join(keepers.withColumnRenamed("id", "src"), "src")
    rank = F.struct((F.col("src") != F.col("keeper")).alias("other"), "src", "value")
    return own.groupBy(F.col("keeper").alias("id"), F.col("dst").alias("property")).agg(F.min_by("value", rank).alias("value"))


# Search focus ------------------------------------------------------------------------------------


def focus_scores(nodes: DataFrame, phrases: list[str], bonus: DataFrame | None = None) -> DataFrame:
    """Nodes (id, label, name) that fit phrases or have a bonus (id, points): id, label, score."""
    scored = nodes.select("id", "label", node_score(F.col("name"), F.col("name"), F.col("label"), phrases).alias("fit"))
    if bonus is None:
        return scored.where("fit > 0").select("id", "label", F.col("fit").alias("score"))
    points = kept(bonus.groupBy("id").agg(F.sum("points").alias("points")))
    return scored.join(points, "id", "left").select("id", "label", (F.col("fit") + F.coalesce("points", F.lit(0))).alias("score")).where("score > 0")


def focus(nodes: DataFrame, edges: DataFrame, phrases: list[str], bonus: DataFrame | None = None, *, primary: int = 10, least: int = 42, visible: int = 24, connector: int = 18, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """What a search shows of a graph: nodes (id, score, is_primary), and links between them (src, dst, way).

    Primary are up to ``primary`` nodes of ``least`` points or more, else up to six of 30 or more.  Bridges are the nodes
    on shortest paths of up to ``most`` steps between two of them, through nodes of other labels than
    SIDE_LABELS or of ``connector`` points; a path's nodes of those labels are not shown themselves.  Of all these
    the ``visible`` best are shown.  Links: along the paths (``path``), the graph's own between shown nodes that are no
    documents (``direct``), and if there are none, from each primary node to the next (``chain``).

    Only primary nodes and the nodes on paths, a bounded number, are ranked in one place.
    """
    scores = kept(focus_scores(nodes, phrases, bonus))
    best = scores.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(primary)
    chosen = kept(best.select("id", "score"))
    if chosen.isEmpty():
        chosen = kept(scores.where("score >= 30").orderBy(F.desc("score"), "id").limit(min(6, primary)).select("id", "score"))
    side = F.col("label").isin(*V.SIDE_LABELS)
    allowed = nodes.select("id", "label").join(scores.select("id", "score"), "id", "left").where(~side | (F.col("score") >= connector)).select("id")
    paths = kept(graph.paths_between(edges, chosen.select("id"), most, allowed))
    on_paths = kept(paths.select(F.explode("path").alias("id")).distinct()).join(nodes.select("id", "label"), "id").where(~side).select("id")
    shown = chosen.select("id").union(on_paths).distinct().join(scores.select("id", "score"), "id", "left").join(chosen.select("id", F.lit(True).alias("is_primary")), "id", "left")
    shown = kept(shown.select("id", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("is_primary", F.lit(False)).alias("is_primary")).orderBy(F.desc("score"), "id").limit(visible))

    ends = lambda df: df.join(shown.select(F.col("id").alias("src")), "src", "left_semi").join(shown.select(F.col("id").alias("dst")), "dst", "left_semi")
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("dst")))).alias("s")).select("s.src", "s.dst", F.lit("path").alias("way"))
    articles = nodes.where("label = 'Document'").select("id")
    own = kept(ends(edges.select("src", "dst")).distinct()).join(articles.withColumnRenamed("id", "src"), "src", "left_anti").join(articles.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", F.lit("direct").alias("way"))
    pair = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "way")
    links = kept(pair(steps).union(pair(own)).groupBy("src", "dst").agg(F.max("way").alias("way")))
    if links.isEmpty():
        order = Window.orderBy(F.desc("score"), "id")  # ten nodes at most
        chained = chosen.select("id", F.lead("id").over(order).alias("next")).where("next IS NOT NULL")
        links = pair(chained.select(F.col("id").alias("src"), F.col("next").alias("dst"), F.lit("chain").alias("way")))
    return shown, ends(links).select("src", "dst", "way")


# Pages, expansion, removal -----------------------------------------------------------------------


def entity_pages(seeds: DataFrame, edges: DataFrame, most: int = 300, skip: tuple[str, ...] = ("HAS_CHUNK", "CONTAINS_IMAGE"), near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages of entities of a document (seeds: document, id): nodes (document, id, is_seed) and edges (document, src, dst, type).

    A page holds its seeds, and up to ``most`` nodes (the first by id) that are linked to one of them and to the document;
    its edges are those that touch a seed and end within the page.  All pages are made at once: what is
    near a document meets the edges once, and only edges whose other end is a seed of the same document stay.
    If it is known which types tie seeds to what documents are tied to, ``edges`` are those of the seeds, and ``near`` those of the documents.
    """
    used = edges.where(~F.col("type").isin(*skip))
    asked = kept(seeds.select("document", "id").distinct())
    way = lambda a, b, out: used.select(F.col(a).alias("a"), F.col(b).alias("b"), "type", F.lit(out).alias("out"))
    touched = way("src", "dst", True).union(way("dst", "src", False)).join(asked.withColumnRenamed("id", "a"), "a").select("document", "a", "b", "type", "out")
    docs = asked.select("document").distinct()
    plain = (edges if near is None else near).select("src", "dst")
    near = plain.union(plain.select("dst", "src")).join(docs.select(F.col("document").alias("src"), "document"), "src").select("document", F.col("dst").alias("b"))
    fit = near.withColumn("is_seed", F.lit(False)).union(asked.select("document", F.col("id").alias("b"), F.lit(True))).groupBy("document", "b").agg(F.max("is_seed").alias("is_seed"))
    rows = kept(touched.join(fit, ["document", "b"]))
    end = lambda out, c: F.when(F.col("out") == out, F.col("a")).otherwise(F.col("b")).alias(c)
    page, edges = _pages(asked, rows.select("document", end(True, "src"), end(False, "dst"), "type", "b", "is_seed"), most)
    return page, edges.distinct()


def known_pages(seeds: DataFrame, ties: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """What ``entity_pages`` gives where it is known already what ties a seed to what its document is tied to: seeds (document, id), ties (document, src, dst, type) from seeds to others, all rows once.

    Nothing is joined, so rows that are dealt out by document stay where they are.
    """
    return _pages(seeds.select("document", "id"), ties.select("document", "src", "dst", "type", F.col("dst").alias("b"), F.lit(False).alias("is_seed")), most)


def _pages(seeds: DataFrame, rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of pages, of edges (document, src, dst, type) with their end ``b`` that is a seed or another node of the document: of the others the first ``most`` stay."""
    place = F.dense_rank().over(Window.partitionBy("document", "is_seed").orderBy(F.asc_nulls_last("b")))
    # One without a document or an end is no edge; that is said of its place, as a filter before it would part what seeds and edges are read from.
    held = rows.withColumn("place", F.when(F.col("document").isNotNull() & F.col("b").isNotNull(), place)).where((F.col("is_seed") & F.col("place").isNotNull()) | (F.col("place") <= most))
    more = held.where("NOT is_seed").select("document", F.col("b").alias("id")).distinct()
    return seeds.withColumn("is_seed", F.lit(True)).union(more.withColumn("is_seed", F.lit(False))), held.select("document", "src", "dst", "type")


def opened(nodes: DataFrame, links: DataFrame, documents: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A view in which some documents (id) and some of their types (document, label) are open: nodes (id, label, hub; clusters have the label Cluster and the cluster's type in ``type``) and links (src, dst) that it keeps.

    Documents stay.  Clusters of an open document stay unless their type is open, then its nodes do.  What
    an open document links to a kept node stays as well.  A graph without documents stays whole; without an open one documents alone stay.
    """
    is_article = F.coalesce(F.col("label") == "Document", F.lit(False))
    articles, others = nodes.where(is_article), nodes.where(~is_article)
    # The open documents, each once: whether the view has them, and their open types.
    shown = types.groupBy(F.col("document").alias("id")).agg(F.collect_set("label").alias("shown"))
    known = articles.select("id").distinct().withColumn("known", F.lit(True))
    doors = kept(documents.select("id").distinct().join(shown, "id", "left").join(known, "id", "left").select("id", F.col("known").isNotNull().alias("known"), F.coalesce("shown", F.array().cast("array<string>")).alias("shown")))
    strays = doors.where("NOT known")
    if doors.where("known").isEmpty() and articles.isEmpty():
        return nodes, links
    kind = F.when(F.col("label") == "Cluster", F.col("type")).otherwise(F.col("label"))
    marked = others.join(doors.select(F.col("id").alias("hub"), "shown"), "hub")
    inside = marked.where((F.col("label") == "Cluster") != F.coalesce(F.array_contains("shown", kind), F.lit(False))).select("id")
    both = links.select("src", "dst").union(links.select("dst", "src"))
    tied = lambda df: both.join(df.select(F.col("id").alias("src")), "src", "left_semi")
    # Documents stay, so what they are linked to does.
    more = inside.union(tied(doors.where("known")).select(F.col("dst").alias("id")))
    if not strays.isEmpty():
        ends = tied(strays)
        stays = articles.select("id").union(inside).select(F.col("id").alias("src"))
        more = more.union(ends.union(ends.select("dst", "src")).join(stays, "src", "left_semi").select("dst"))
    held = articles.union(others.join(more, "id", "left_semi").select(*nodes.columns))
    final = articles.select("id").union(more).distinct()
    return held, links.join(final.select(F.col("id").alias("src")), "src", "left_semi").join(final.select(F.col("id").alias("dst")), "dst", "left_semi").select(*links.columns)


def without_documents(nodes: DataFrame, links: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A view (nodes: id, label, document_id, hub) without documents (id), their clusters and what belongs to them; and its links without those that touch any."""
    gone = documents.select("id")
    of = lambda c: nodes.where("label <> 'Document'").join(gone.select(F.col("id").alias(c)), c, "left_semi").select("id")
    cluster = nodes.where(F.startswith("id", F.lit("cluster:"))).select("id", F.regexp_extract("id", "^cluster:(.*):[^:]*$", 1).alias("owner"))
    drop = gone.union(of("document_id")).union(of("hub")).union(cluster.join(gone.select(F.col("id").alias("owner")), "owner", "left_semi").select("id")).distinct()
    drop = kept(drop)
    left = links.join(drop.select(F.col("id").alias("src")), "src", "left_anti").join(drop.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(drop, "id", "left_anti").select(*nodes.columns), left.select(*links.columns)


# Values and questions ----------------------------------------------------------------------------


def value_class(value: Column, unit: Column) -> Column:
    """What a value is shown as: kind (composition, threshold, range or scalar) and text; four parts of a composition at most, with the number of the others."""
    raw, own = T.strip(F.coalesce(value, F.lit(""))), F.coalesce(F.nullif(T.strip(unit), F.lit("")), F.lit(""))
    parts = F.from_json(F.when(T.has(raw, r"(?s)^\{.*\}$"), F.replace(raw, F.lit("'"), F.lit('"'))), "map<string,string>")
    entry = lambda e: F.concat(e["key"], F.lit(" "), T.strip(F.regexp_replace(F.coalesce(e["value"], F.lit("null")), r"^<\s*", "<")), F.when(own != "", F.concat(F.lit(" "), own)).otherwise(""))
    shown = T.bind(F.map_entries(parts), lambda es: F.concat(F.array_join(F.transform(F.slice(es, 1, 4), entry), " · "), F.when(F.size(es) > 4, F.concat(F.lit(" +"), (F.size(es) - 4).cast("string"))).otherwise("")))
    several = F.coalesce(F.size(parts) > 0, F.lit(False))
    kind = F.when(several, "composition").when(T.has(raw, r"^<\s*[\d.,]+"), "threshold").when(T.has(raw, r"[\d.,]+\s*[-–—]\s*[\d.,]+"), "range").otherwise("scalar")
    return F.struct(kind.alias("kind"), F.when(raw == "", "—").when(several, shown).otherwise(raw).alias("shown"))


def parsed_query(query: Column) -> Column:
    """The first known material, process and property that a question names, its geography, and its key words."""
    low = F.lower(query)

    def first(terms: list[str]) -> Column:
        return F.coalesce(*(F.when(F.contains(low, F.lit(t)), t) for t in terms))

    words = F.filter(F.split(F.regexp_replace(low, r"(?iu)[^a-z0-9а-яё\s-]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*V.QUERY_STOP))
    geography = F.when(T.has(query, "(?iu)росси|domestic|отечеств|cis"), "domestic").when(T.has(query, "(?iu)international|global|зарубеж|миров"), "international")
    return F.struct(first(V.QUERY_MATERIALS).alias("material"), first(V.QUERY_PROCESSES).alias("mode"), first(V.QUERY_PROPERTIES).alias("property"), geography.alias("geography"), words.alias("keywords"))
