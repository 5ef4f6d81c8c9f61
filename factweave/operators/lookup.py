"""Lookups, details and lists over documents, chunks, nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import questions as Q
from factweave.functions import text as T
from factweave.operators import graph


def any_term(text: Column, terms: list[str]) -> Column:
    return T.any_of(F.lower(F.coalesce(text, F.lit(""))), terms)


def search_nodes(nodes: DataFrame, terms: list[str], fields: list[str], lists: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """Nodes of which a field, or an entry of a list, holds any term; the first by id."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | any_term(F.col(f), terms)
    for f in lists:
        hit = hit | F.coalesce(F.exists(f, lambda x: any_term(x, terms)), F.lit(False))
    return nodes.where(hit).orderBy("id").limit(limit)


def similar_materials(materials: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Materials whose name or alias holds a name."""
    word = F.lit(name.lower())
    return materials.where(F.contains(F.lower("name"), word) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), word)), F.lit(False))).orderBy("id").limit(limit)


def material_by_key(materials: DataFrame, names: DataFrame) -> DataFrame:
    """For each name the material with its canonical key, else one without key and with the same name: name, id (the smallest)."""
    asked = names.select("name").distinct().withColumn("key", T.canonical_key(F.col("name")))
    by_key = materials.where("canonical_key <> ''").groupBy(F.col("canonical_key").alias("key")).agg(F.min("id").alias("by_key"))
    by_name = materials.where("coalesce(canonical_key, '') = ''").groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("by_name"))
    return asked.join(by_key, "key", "left").withColumn("low", F.lower("name")).join(by_name, "low", "left").select("name", F.coalesce("by_key", "by_name").alias("id"))


def documents_by(documents: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Documents for each asked value of a key, newest first: key, id, place."""
    order = Window.partitionBy(key).orderBy(F.col("created_at").desc_nulls_last(), "id")
    return documents.join(asked.select(key).distinct(), key).select(key, "id", F.row_number().over(order).alias("place"))


def base_name(path: Column) -> Column:
    """The last part of a path with either slash, in lower case."""
    return F.lower(F.regexp_replace(path, r"^.*[/\\]", ""))


def rebuilt(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their chunks in order: id, title, texts."""
    lists = chunks.groupBy(F.col("doc_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]).alias("texts"))
    return documents.select("id", "title").join(lists, "id", "left").select("id", "title", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def with_entities(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with whether they have a process, an author, a team or an experiment: id, enriched."""
    out = edges.where("type IN ('DESCRIBES_PROCESS', 'AUTHORED_BY')").select(F.col("src").alias("id"))
    into = edges.where("type IN ('AUTHORED', 'DESCRIBED_IN')").select(F.col("dst").alias("id"))
    found = out.union(into).distinct().withColumn("enriched", F.lit(True))
    return documents.select("id").join(found, "id", "left").select("id", F.coalesce("enriched", F.lit(False)).alias("enriched"))


def all_tokens(query: str, *fields: Column) -> Column:
    """Whether every word of a query stands somewhere in the fields."""
    hay = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(True)
    for token in query.lower().split():
        out = out & F.contains(hay, F.lit(token))
    return out


def visual_edges(edges: DataFrame, nodes: DataFrame, ends: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Edges without those that touch a document; ``ends``: the types that start from documents, and that lead to them, if known."""
    return graph.untouched(edges, nodes.where("label = 'Document'"), ends)


def display_label(label: Column, name: Column, value: Column | None = None, unit: Column | None = None) -> Column:
    """What a node is shown as: a property by its label with value and unit, others by name; 48 characters at most."""
    shown = F.when(label == "Property", T.property_label(name)).otherwise(name)
    if value is not None:
        shown = F.when((label == "Property") & value.isNotNull(), F.concat(shown, F.lit(": "), F.trim(F.concat_ws(" ", value, unit if unit is not None else F.lit(""))))).otherwise(shown)
    return F.when(F.length(shown) > 48, F.concat(F.rtrim(F.substring(shown, 1, 47)), F.lit("…"))).otherwise(shown)


def connections(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """What a node is linked to: id, label, name, relation, direction, by label and name."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), F.col("type").alias("relation"), F.lit("out").alias("direction"))
    into = edges.where((F.col("dst") == node) & (F.col("src") != node)).select(F.col("src").alias("id"), F.col("type").alias("relation"), F.lit("in").alias("direction"))
    return nodes.join(out.union(into).distinct(), "id").select("id", "label", "name", "relation", "direction").orderBy("label", F.lower("name"), "id", "relation")


def material_details(materials: DataFrame, experiments: DataFrame, documents: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Each material's own property values, and its ``limit`` newest experiments with their documents: id, kind, key, value, title.

    Values are those of the material itself, not of others that share the property.
    """
    own = edges.where("type = 'HAS_PROPERTY'").select(F.col("src").alias("id"), F.lit("property").alias("kind"), F.substring("dst", 6, 1 << 30).alias("key"), "value", F.lit(None).cast("string").alias("title"))
    used = edges.where("type = 'USES_MATERIAL'").select(F.col("src").alias("experiment"), F.col("dst").alias("id"))
    dated = used.join(experiments.select(F.col("id").alias("experiment"), "regime_name", "created_at"), "experiment")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("created_at").desc_nulls_first(), "experiment"))
    newest = dated.withColumn("place", place).where(F.col("place") <= limit)
    described = edges.where("type = 'DESCRIBED_IN'").select(F.col("src").alias("experiment"), F.col("dst").alias("document"))
    titled = newest.join(described, "experiment", "left").join(documents.select(F.col("id").alias("document"), "title"), "document", "left")
    rows = titled.select("id", F.lit("experiment").alias("kind"), F.col("experiment").alias("key"), F.col("regime_name").alias("value"), "title")
    return own.unionByName(rows).join(materials.select("id"), "id", "left_semi")


def experiment_details(experiments: DataFrame, materials: DataFrame, documents: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Each experiment with its material, its document and its measured values: id, regime_name, material, title, measured (sorted structs).

    Without edges, the experiments have what theirs lead to side by side: material_id, document_id, measured (property, value).
    """
    if edges is None:
        values = F.array_sort(F.array_distinct(F.transform("measured", lambda v: F.struct(F.substring(v["property"], 6, 1 << 30).alias("name"), v["value"].alias("value")))))
        out = experiments.select("id", "regime_name", "material_id", "document_id", "measured")
        out = out.join(materials.select(F.col("id").alias("material_id"), F.col("name").alias("material")), "material_id", "left")
        out = out.join(documents.select(F.col("id").alias("document_id"), "title"), "document_id", "left")
        return out.select("id", "regime_name", "material", "title", values.alias("measured"))
    end = lambda kind, name: edges.where(F.col("type") == kind).select(F.col("src").alias("id"), F.col("dst").alias(name))
    values = edges.where("type = 'MEASURED'").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.substring("dst", 6, 1 << 30).alias("name"), "value"))).alias("measured"))
    out = experiments.select("id", "regime_name").join(end("USES_MATERIAL", "m"), "id", "left").join(materials.select(F.col("id").alias("m"), F.col("name").alias("material")), "m", "left")
    out = out.join(end("DESCRIBED_IN", "d"), "id", "left").join(documents.select(F.col("id").alias("d"), "title"), "d", "left")
    return out.join(values, "id", "left").select("id", "regime_name", "material", "title", "measured")


def property_details(edges: DataFrame, prop: str) -> DataFrame:
    """All values of a property, measured by experiments or owned by materials, each once: source, id, value."""
    of = lambda kind, source: edges.where((F.col("type") == kind) & (F.col("dst") == f"prop:{prop}") & F.coalesce(F.col("value") != "", F.lit(False))).select(F.lit(source).alias("source"), F.col("src").alias("id"), "value")
    return of("MEASURED", "experiment").unionByName(of("HAS_PROPERTY", "material")).distinct()


def property_languages(edges: DataFrame, languages: DataFrame) -> DataFrame:
    """A property's language: the one that more of its documents' languages (id, language) are, ru if as many: property, language."""
    docs = edges.where("type = 'DESCRIBED_IN'").select("src", F.col("dst").alias("id"))
    seen = edges.where("type = 'MEASURED'").select("src", F.col("dst").alias("property")).join(docs, "src").join(languages, "id").select("property", "language").distinct()
    count = lambda x: F.count_if(F.col("language") == x)
    return seen.groupBy("property").agg(F.when(count("en") > count("ru"), "en").otherwise("ru").alias("language"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of a list, each row with the total and whether there is more behind the page."""
    counted = rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", rows.agg(F.count("*")).scalar())
    return counted.withColumn("has_more", F.col("total") > offset + limit)


def browse(nodes: DataFrame, label: str, question: str | None, offset: int, limit: int) -> DataFrame:
    """A page of the nodes of a label whose name holds a term of a question, by name: id, name, total, has_more."""
    rows = nodes.where(F.col("label") == label)
    if question and question.strip():
        terms = Q.search_terms(F.lit(question), 8)
        rows = rows.where(F.exists(terms, lambda t: F.contains(F.lower("name"), t)))
    return page(rows.select("id", "name"), [F.lower("name"), "id"], offset, limit)


def document_list(documents: DataFrame, galleries: DataFrame, limit: int) -> DataFrame:
    """The newest documents with the number of their images: of the gallery, else 0."""
    counted = documents.join(galleries.select(F.col("doc_id").alias("id"), "image_count"), "id", "left")
    return counted.select("id", "title", "document_type", "year", F.coalesce("image_count", F.lit(0)).cast("long").alias("images"), "created_at").orderBy(F.desc_nulls_first("created_at"), "id").limit(limit)


def overview(nodes: DataFrame, edges: DataFrame, documents: DataFrame, newest: int = 25, labels: tuple[str, ...] = ("Document", "Material", "Experiment", "Process", "Team")) -> DataFrame:
    """The nodes of the newest documents: those, what they are linked to, their experiments and what those use: id, label."""
    docs = documents.orderBy(F.desc_nulls_last("created_at"), "title", "id").limit(newest).select("id")
    shown = nodes.where(F.col("label").isin(*labels)).select("id")
    near = edges.join(docs.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).union(edges.join(docs.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src"))
    described = edges.where("type = 'DESCRIBED_IN'").join(docs.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src")
    chained = edges.where("type IN ('USES_MATERIAL', 'MEASURED', 'HAS_REGIME_PARAM', 'USES_PROCESS')").join(described, "src", "left_semi").select(F.col("dst").alias("id"))
    ids = docs.union(near.join(shown, "id", "left_semi")).union(described).union(chained).distinct()
    return nodes.join(ids, "id", "left_semi").select("id", "label")


def backfilled(edges: DataFrame, materials: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges with a MENTIONS_MATERIAL edge from the document that each material (id, source_document_id) came from."""
    known = materials.where("source_document_id IS NOT NULL").select(F.col("source_document_id").alias("src"), F.col("id").alias("dst"))
    made = known.join(documents.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", F.lit("MENTIONS_MATERIAL").alias("type"))
    return edges.select("src", "dst", "type").unionByName(made).distinct()


def linked_by_name(experiments: DataFrame, materials: DataFrame) -> DataFrame:
    """Experiments (id, material_name, material_id) with the material of their name, blanks and case aside, else the one they had: id, material."""
    names = materials.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("id").alias("found"))
    return experiments.withColumn("key", F.lower(F.trim("material_name"))).join(names, "key", "left").select("id", F.coalesce("found", "material_id").alias("material"))


def person_key(name: Column) -> Column:
    """First and last word of a person's name, in lower case."""
    parts = F.split(T.strip(F.lower(T.person_name(name))), r"\s+")
    return F.concat_ws("_", F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 1)))


def experts_in_teams(experts: DataFrame, teams: DataFrame) -> DataFrame:
    """Experts (id, name) and the teams (id, members) that have a member of their key: expert, team."""
    members = teams.select(F.col("id").alias("team"), F.explode("members").alias("m")).select("team", person_key(F.col("m")).alias("key")).distinct()
    return experts.select(F.col("id").alias("expert"), person_key(F.col("name")).alias("key")).where("key <> ''").join(members, "key").select("expert", "team").distinct()


def titled(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (doc_id) with the titles of their documents."""
    return hits.join(documents.select(F.col("id").alias("doc_id"), "title"), "doc_id", "left")


def document_experiments(edges: DataFrame | None, experiments: DataFrame, galleries: DataFrame) -> DataFrame:
    """Experiments of each document with what they measured, and the document's images: document, id, regime_name, properties, images.

    Without edges, the experiments have what theirs lead to side by side: document_id, measured (property, value).
    """
    images = galleries.select(F.col("doc_id").alias("document"), F.col("image_count").alias("images"))
    shown = F.coalesce("images", F.lit(0)).cast("long").alias("images")
    if edges is None:
        names = F.array_sort(F.array_distinct(F.transform("measured", lambda v: F.substring(v["property"], 6, 1 << 30))))
        return experiments.select(F.col("document_id").alias("document"), "id", "regime_name", names.alias("properties")).join(images, "document", "left").select("document", "id", "regime_name", "properties", shown)
    described = edges.where("type = 'DESCRIBED_IN'").select(F.col("src").alias("id"), F.col("dst").alias("document"))
    found = edges.where("type = 'MEASURED'").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.substring("dst", 6, 1 << 30))).alias("properties"))
    return described.join(experiments.select("id", "regime_name"), "id").join(found, "id", "left").join(images, "document", "left").select("document", "id", "regime_name", "properties", shown)


def cluster_counts(members: DataFrame) -> DataFrame:
    """Type clusters of each document in place of its members (document, id, label): document, cluster, label, n."""
    return members.groupBy("document", "label").agg(F.countDistinct("id").alias("n")).select("document", F.concat_ws(":", F.lit("cluster"), "document", "label").alias("cluster"), "label", "n")


def activity(tasks: DataFrame) -> DataFrame:
    """One row: how many tasks (task_id, status, message, created_at) run, and the message of the first of them."""
    running = F.col("status").isin("running", "pending")
    return tasks.agg(F.count_if(running).alias("active"), F.min_by(F.when(running, F.col("message")), F.when(running, F.struct("created_at", "task_id"))).alias("message"))
