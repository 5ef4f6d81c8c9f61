"""What texts, tables and raw answers say: processes, classes of names, facts, tables, and merged passes over a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.functions import questions as Q
from factweave.functions import scores as S
from factweave.functions import text as T
from factweave.functions import values as V
from factweave.store import kept


def template(name: Column) -> Column:
    """Whether a name is left over from a prompt: too short, a known phrase, in angle brackets or with dots in place of text."""
    low = F.lower(T.entity_name(name))
    return (F.length(low) < 2) | low.isin(*V.TEMPLATES) | (F.startswith(low, F.lit("<")) & F.endswith(low, F.lit(">"))) | F.contains(low, F.lit("...")) | F.endswith(low, F.lit("…"))


def placeholder(name: Column, kind: str) -> Column:
    """Whether a name is no more than the word for its kind (equipment, process, topic or field)."""
    low = F.lower(T.entity_name(name))
    plain = low.isin(*V.PLACEHOLDERS[kind])
    return plain | (low == "") | template(name) if kind == "topic" else plain


def process_label(name: Column) -> Column:
    """Whether a name can be a process's."""
    low = F.lower(T.entity_name(name))
    usable = (F.length(low) >= 4) & ~template(name) & ~placeholder(name, "process") & ~low.isin("base", "other", "unknown", "none")
    return usable & (K.concept(T.entity_name(name)) | T.any_of(low, V.PROCESS_HINTS))


def processes(text: Column) -> Column:
    """Keys of the processes that a text names, by phrases first, then by the glossary."""
    phrased = [F.when(T.has(text, f"(?iu){p}"), F.lit(k)) for p, k in V.PROCESS_PHRASES] + [F.when(T.has(text, T.bounded(w)), F.lit(k)) for w, k in V.PROCESS_WORDS.items()]
    return F.array_distinct(F.concat(F.array_compact(F.array(*phrased)), F.filter(T.glossary_keys(text), lambda k: k.isin(*V.PROCESS_KEYS))))


def reliability(kind: Column) -> Column:
    """How far a type of document is relied on."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in V.RELIABILITY.items() for x in pair)), F.lower(kind)), F.lit(V.RELIABILITY["other"]))


def place(country: Column, scope: Column) -> Column:
    """country and scope as far as they are stated: no words of a prompt, and one of the known scopes."""
    low = F.lower(T.strip(F.coalesce(scope, F.lit(""))))
    clean = T.strip(F.coalesce(country, F.lit("")))
    return F.struct(F.when((clean != "") & ~template(clean), clean).alias("country"), F.when(low.isin("domestic", "international", "global"), low).alias("scope"))


def inferred_classes(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The class of each name by the terms that it holds: name, material_class.

    ``taxonomy``: class, rank, term, alias (whether the term is one).  A pattern
    counts three (two if shorter than five letters), an alias of four letters or more
    two; the largest sum wins, then the first rank.  Names meet terms by the first
    three letters of the term, so neither side has to be small.
    """
    terms = taxonomy.select("class", "rank", F.lower(F.trim("term")).alias("term"), "alias").where("term <> '' AND (NOT alias OR length(term) >= 4)").withColumn("gram", F.substring("term", 1, 3))
    low = F.lower(F.trim("name"))
    n = F.length(low)
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(k)))
    asked = names.select("name").distinct().where(n >= 2).withColumn("low", low)
    met = asked.select("name", "low", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram")).join(terms, "gram").where(F.contains("low", F.col("term")))
    points = F.when(F.col("alias"), 2).when(F.length("term") >= 5, 3).otherwise(2)
    sums = met.select("name", "class", "rank", "term", "alias", points.alias("points")).distinct().groupBy("name", "class", "rank").agg(F.sum("points").alias("score"))
    best = sums.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank", "class")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("b.class", F.lit("other")).alias("material_class"))


def class_siblings(stages: DataFrame) -> DataFrame:
    """Each class (class, stage) with the classes of its stage; those without a stage and of the stage "other" stand alone: class, sibling."""
    other = stages.select("stage", F.col("class").alias("sibling"))
    staged = stages.where("stage <> 'other'").join(other, "stage").select("class", "sibling")
    return staged.unionByName(stages.where("stage = 'other' OR stage IS NULL").select("class", F.col("class").alias("sibling")))


def finding_material(findings: DataFrame, materials: DataFrame) -> DataFrame:
    """For each finding (finding_id, doc_id, text) the material of its document (doc_id, material_id, name, aliases, seq) that it names, itself or by an alias, else the first: finding_id, material_id."""
    low = F.lower("text")
    met = findings.join(materials, "doc_id")
    rank = F.when(F.contains(low, F.lower("name")), 0).when(F.coalesce(F.exists("aliases", lambda a: (a != "") & F.contains(low, F.lower(a))), F.lit(False)), 1).otherwise(2)
    return met.groupBy("finding_id").agg(F.min(F.struct(rank.alias("r"), "seq", "material_id")).alias("b")).select("finding_id", F.col("b.material_id").alias("material_id"))


def facts(answer: Column) -> Column:
    """Claims with their source numbers in a model's JSON answer ({"facts": [...]} or a list, perhaps fenced): those that have both."""
    kind = "array<struct<claim:string,text:string,sources:array<string>>>"
    fenced = F.coalesce(F.nullif(F.regexp_extract(answer, r"(?is)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), F.regexp_extract(answer, r"(?s)(\{.*\}|\[.*\])", 1))
    listed = F.coalesce(F.from_json(fenced, f"struct<facts:{kind}>")["facts"], F.from_json(fenced, kind))
    clean = F.transform(listed, lambda f: F.struct(T.strip(F.coalesce(F.nullif(f["claim"], F.lit("")), f["text"], F.lit(""))).alias("claim"), F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(f["sources"], F.array().cast("array<string>")), lambda s: T.has(s, r"^\d+$")), lambda s: s.cast("int")))).alias("sources")))
    return F.coalesce(F.filter(clean, lambda f: (f["claim"] != "") & (F.size(f["sources"]) > 0)), F.array().cast("array<struct<claim:string,sources:array<int>>>"))


def fact_lines(found: Column) -> Column:
    """Facts as numbered lines with their citations."""
    marks = lambda s: F.array_join(F.transform(s, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")
    return F.array_join(F.transform(found, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f["claim"], F.lit(" "), marks(f["sources"]))), "\n")


def addresses(question: Column, found: Column) -> Column:
    """Whether facts can answer a question: a number where one is asked with a number, a year where time is, harm where that is, and one of its words."""
    claims = F.array_join(F.transform(found, lambda f: f["claim"]), " ")
    low, technical = F.lower(claims), Q.asks_technical(question)
    number = ~T.has(question, r"\d") | T.has(claims, r"\d")
    hurt = ~T.any_of(F.lower(question), ["harm", "damage", "overcharge", "вред", "ущерб", "переплат"]) | T.any_of(low, ["harm", "damage", "overcharge", "%", "вред", "ущерб", "переплат"])
    terms = T.significant_terms(question, 4)
    other = (~Q.asks_time(question) | (S.years(claims) > 0)) & hurt & ((F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(low, t)))
    return (F.size(found) > 0) & F.when(technical, number).otherwise(other)


def table_rows(chunks: DataFrame) -> DataFrame:
    """Numbers in the Markdown tables of chunks (chunk_id, text), with the header of their column and the first cell of their row: chunk_id, table, row, head, zone, value."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(T.strip(line), r"^\||\|$", ""), r"\|"), T.strip)
    lines = lambda b: F.filter(F.transform(F.split(F.regexp_replace(b, r"(?i)\[/?TABLE\]", "\n"), "\n"), T.strip), lambda x: F.contains(x, F.lit("|")) & ~T.has(x, r"^[|\s:-]+$"))
    tables = chunks.select("chunk_id", F.posexplode(F.transform(T.table_blocks(F.col("text")), lambda b: F.transform(lines(b), cells))).alias("table", "rows")).where(F.size("rows") > 1)
    rows = tables.select("chunk_id", "table", F.col("rows")[0].alias("heads"), F.posexplode("rows").alias("row", "cells")).where("row > 0")
    each = rows.select("chunk_id", "table", "row", "heads", F.col("cells")[0].alias("zone"), F.posexplode("cells").alias("at", "cell")).where("at > 0")
    value = T.plain_number(F.regexp_extract("cell", r"^[<>≤≥~]?\s*(-?\d+(?:[.,]\d+)?)", 1))
    return each.select("chunk_id", "table", "row", F.get("heads", F.col("at")).alias("head"), "zone", value.alias("value")).where("value IS NOT NULL")


def merged_passes(passes: DataFrame, key: list[str], first: list[str], last: list[str], lists: list[str]) -> DataFrame:
    """Rows of several passes over a document (seq) by key: the first value of some columns that is not blank, the last of others, and lists as sets."""
    given = lambda c: F.when(T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.col("seq"))
    out = [F.min_by(c, given(c)).alias(c) for c in first] + [F.max_by(c, given(c)).alias(c) for c in last]
    return passes.groupBy(*key).agg(*out, *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists))


def unique_rows(rows: DataFrame, keys: dict[str, Column], order: list[str]) -> DataFrame:
    """The first row, by order, of those with the same keys."""
    marked = rows.withColumns({f"_k_{n}": c for n, c in keys.items()})
    place = F.row_number().over(Window.partitionBy(*(f"_k_{n}" for n in keys)).orderBy(*order))
    return marked.withColumn("_place", place).where("_place = 1").select(*rows.columns)


def resolved_title(core: Column, heading: Column, paragraphs: Column, stem: Column) -> Column:
    """A document's title: its own property, else its heading, else the first paragraph of 12 to 280 characters, else its file's name; texts shaped like a person's or organisation's name are none."""
    named = lambda c: K.person(T.entity_name(c)) | K.organisation(T.entity_name(c))
    usable = lambda c: F.when((T.strip(c) != "") & ~named(c), T.strip(c))
    body = F.get(F.filter(F.transform(paragraphs, T.strip), lambda p: F.length(p).between(12, 280) & ~named(p)), F.lit(0))
    return F.coalesce(usable(core), usable(heading), body, T.upload_title(stem))


def titled_processes(chunks: DataFrame) -> DataFrame:
    """Section titles of chunks (doc_id, section_title) that name a process, each once a document: doc_id, key, name.

    Documents share titles, so each different title is judged once; what documents have of titles is stored for that, each pair once.
    """
    pairs = kept(chunks.where("section_title IS NOT NULL").select("doc_id", "section_title").distinct())
    # Stored as well, as Spark would judge the pairs before it makes their titles distinct.
    named = kept(pairs.select("section_title").distinct()).withColumn("name", T.entity_name(F.col("section_title")))
    titles = kept(named.where(process_label(F.col("name"))).withColumn("key", T.canonical_key(F.col("name"))))
    return pairs.join(titles, "section_title").groupBy("doc_id", "key").agg(F.min("name").alias("name"))


def to_translate(strings: DataFrame, language: str) -> DataFrame:
    """Distinct strings (text) that are not in the language: with letters, most of them of the other script, and without a glossary name in the language."""
    cyrillic, latin = T.count(F.col("text"), T.CYRILLIC), T.count(F.col("text"), "[A-Za-z]")
    foreign = cyrillic > latin if language == "en" else latin > cyrillic
    known = T.strip(F.col("text")) != T.glossary_name(F.col("text"), language)
    return strings.select("text").distinct().where(foreign & ~known)


def distinct_tables(tables: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Tables of each page (doc_id, page, x0, y0, x1, y1, quality, text) without those that share half of the smaller area with a better one: the best quality first, then the longest text.

    A page's few tables are judged together, page by page.
    """

    def keep(page):
        page = page.assign(n=page.text.str.len().fillna(0)).sort_values(["quality", "n", "y0", "x0"], ascending=[False, False, True, True])
        chosen = []
        for t in page.itertuples(index=False):
            area = max(1.0, (t.x1 - t.x0) * (t.y1 - t.y0))
            shared = lambda o, t=t, area=area: max(0.0, min(t.x1, o.x1) - max(t.x0, o.x0)) * max(0.0, min(t.y1, o.y1) - max(t.y0, o.y0)) / min(area, max(1.0, (o.x1 - o.x0) * (o.y1 - o.y0)))
            if all(shared(o) < overlap for o in chosen):
                chosen.append(t)
        return page.iloc[0:0].drop(columns="n") if not chosen else type(page)(chosen).drop(columns="n")

    return tables.groupBy("doc_id", "page").applyInPandas(keep, tables.schema)


def experiment_label(name: Column) -> Column:
    """Whether a name can be an experiment's."""
    clean = T.entity_name(name)
    return (F.length(clean) >= 6) & ~template(clean) & T.any_of(F.lower(clean), V.EXPERIMENT_HINTS)


def inline_numbers(text: Column) -> Column:
    """Numbers that a text states of itself ("E = 5 GPa"): the first of each property, as structs of property, value and unit."""

    def found(prop: str, pattern: str, unit: str) -> Column:
        part = lambda i: F.regexp_extract(text, f"(?iu){pattern}", i)
        own = F.coalesce(F.nullif(part(2), F.lit("")), F.nullif(F.lit(unit), F.lit("")))
        return F.when(part(1) != "", F.struct(F.lit(prop).alias("property"), T.plain_number(F.regexp_replace(part(1), "[.,]+$", "")).alias("value"), own.alias("unit")))

    return F.array_compact(F.array(*(found(p, pattern, unit) for p, (pattern, unit) in V.INLINE_NUMBERS.items())))


def experiments(text: Column) -> Column:
    """Keys of the experiments that a text names; inline_parameters if it names none but states numbers."""
    phrased = F.array_compact(F.array(*(F.when(T.has(text, f"(?iu){p}"), F.lit(k)) for p, k in V.EXPERIMENT_PHRASES)))
    return T.bind(phrased, lambda p: F.when((F.size(p) == 0) & (F.size(inline_numbers(text)) > 0), F.array(F.lit("inline_parameters"))).otherwise(p))


def experiment_fingerprint(name: Column, parameters: Column, measured: Column) -> Column:
    """What makes two experiments one: name, parameters but for the status, and measured values (maps), in order of keys."""
    cells = lambda m, skip=(): F.array_join(F.array_sort(F.transform(F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*skip) if skip else F.lit(True)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "|")
    return F.concat_ws("|", F.lower(T.strip(F.coalesce(name, F.lit("")))), cells(parameters, ("status",)), cells(measured))


def pruned_bullets(answers: DataFrame, sources: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """Answers (answer_id, answer) without numbered lines that are bare headings and have no support: answer_id, answer.

    A heading (up to seven capitalised words, no number) stays if its cited excerpts
    (``sources``: answer_id, n, text) hold it, are no list of short lines, and hold a
    word of ``focus``, if any.
    """
    lines = answers.select("answer_id", F.posexplode(F.split("answer", "\n")).alias("i", "line"))
    claim = T.strip(F.regexp_extract("line", r"^\s*\d+\.\s+(.+?)(?:\s+\[\d+(?:\s*,\s*\d+)*\])+\s*$", 1))
    bare = F.regexp_replace(claim, r"\.+$", "")
    names = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    letter = lambda w: F.substring(w, 1, 1)
    capital = F.forall(names, lambda w: (F.upper(letter(w)) == F.lower(letter(w))) | ((F.upper(letter(w)) == letter(w)) & (F.lower(letter(w)) != letter(w))))
    marked = lines.select("answer_id", "i", "line", claim.alias("claim"), ((claim != "") & (F.length(bare) <= 80) & ~T.has(bare, r"\d") & F.size(names).between(1, 7) & capital).alias("heading"))
    cited = marked.where("heading").select("answer_id", "i", F.explode(F.transform(T.every(F.col("line"), r"\[(\d+)\]", 1), lambda n: n.cast("int"))).alias("n")).join(sources, ["answer_id", "n"])
    texts = cited.groupBy("answer_id", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), "\n").alias("held"))
    short = lambda x: (F.length(x) < 55) & (F.size(F.split(x, r"\s+")) <= 6)
    listed = F.filter(F.transform(F.split("held", "\n"), T.strip), lambda x: x != "")
    contents = (F.size(listed) >= 3) & (F.size(F.filter(listed, short)) / F.size(listed) >= 0.55)
    supported = F.contains(F.lower("held"), F.lower("claim")) & ~contents & (T.any_of(F.lower("held"), [f.lower() for f in focus]) if focus else F.lit(True))
    kept = marked.join(texts, ["answer_id", "i"], "left").where(~F.col("heading") | F.coalesce(supported, F.lit(False)))
    whole = kept.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("kept"))
    return answers.select("answer_id").join(whole, "answer_id", "left").select("answer_id", F.coalesce("kept", F.lit("")).alias("answer"))


def experiment_union(existing: DataFrame, found: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Experiments (name, parameters, measured and others) of two passes: all existing ones, and of those found the first, by order, of each fingerprint that the existing ones of the same key lack."""
    marked = lambda df: df.withColumn("_print", experiment_fingerprint(F.col("name"), F.col("parameters"), F.col("measured")))
    fresh = marked(found).join(marked(existing).select(*key, "_print").distinct(), [*key, "_print"], "left_anti")
    first = unique_rows(fresh, {"print": F.col("_print"), **{k: F.col(k) for k in key}}, order)
    return existing.unionByName(first.select(*existing.columns))


def header_property(head: Column) -> Column:
    """The property and unit (struct) that a column's header stands for, by the table of headers or by its parts; null for others."""
    norm = F.lower(T.regexp_clean(head))
    known = F.coalesce(*(F.when(norm.isin(*[h for h, v in V.HEADER_PROPERTIES.items() if v == pair]), F.struct(F.lit(pair[0]).alias("property"), F.lit(pair[1]).alias("unit"))) for pair in dict.fromkeys(V.HEADER_PROPERTIES.values())))
    pair = lambda p, u: F.struct(F.lit(p).alias("property"), F.lit(u).alias("unit"))
    has = lambda x: F.contains(norm, F.lit(x))
    told = F.when(F.endswith(norm, F.lit(", mpa")) | (has("модул") & has("упруг")), pair("elastic_modulus", "MPa")).when(has("пуассон"), pair("poisson_ratio", "")).when(has("плотност") | has("density"), pair("density", "kg/m3"))
    return F.coalesce(known, told)


def table_experiments(chunks: DataFrame, title: str = "Table row") -> DataFrame:
    """Experiments that rows of the tables in chunks (chunk_id, text) state: chunk_id, table, row, title, summary, measured (property, value, unit).

    A table has a header, a rule and rows.  The column whose header speaks of zones, materials and the like names the
    row, else the first; an empty name is the table's caption (a line before it), else ``title``.  Columns count whose header stands for
    a property; a row without a number in them is no experiment.  Values are numbers, or texts with one.
    """
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), T.strip), lambda x: (x != "") & ~F.startswith(F.upper(x), F.lit("[TABLE")))
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), T.strip)
    tables = chunks.select("chunk_id", F.posexplode(F.transform(T.table_blocks(F.col("text")), lines)).alias("table", "lines"))
    barred = F.filter("lines", lambda x: F.startswith(x, F.lit("|")))
    first = F.get("lines", F.lit(0))
    tables = tables.select("chunk_id", "table", F.when(~F.startswith(first, F.lit("|")), first).otherwise("").alias("caption"), barred.alias("rows")).where("size(rows) >= 3")
    heads = tables.withColumn("heads", F.transform(cells(F.get("rows", F.lit(0))), lambda h: F.lower(T.regexp_clean(h))))
    zone = F.greatest(F.array_position(F.transform("heads", lambda h: T.has(h, "|".join(V.ROW_HEADERS))), F.lit(True)).cast("int") - 1, F.lit(0))
    marked = heads.withColumn("zone", zone).withColumn("columns", F.filter(F.transform("heads", lambda h, i: F.struct(i.alias("at"), header_property(h).alias("p"))), lambda c: c["p"].isNotNull() & (c["at"] != F.col("zone"))))
    rows = marked.where("size(columns) > 0").select("chunk_id", "table", "caption", "zone", "columns", F.posexplode(F.slice("rows", F.lit(3), F.size("rows"))).alias("row", "line"))
    split = rows.withColumn("cells", cells(F.col("line")))
    text = lambda c: F.coalesce(F.get("cells", c["at"]), F.lit(""))
    value = lambda c: F.coalesce(T.plain_number(text(c)).cast("string"), F.replace(text(c), F.lit(","), F.lit(".")))
    measured = F.transform(F.filter("columns", lambda c: T.has(text(c), r"\d")), lambda c: F.struct(c["p"]["property"].alias("property"), value(c).alias("value"), c["p"]["unit"].alias("unit")))
    named = F.coalesce(F.nullif(F.get("cells", F.col("zone")), F.lit("")), F.nullif(F.col("caption"), F.lit("")), F.lit(title))
    shown = F.when((F.col("caption") != "") & ~F.contains(F.lower(named), F.lower("caption")), F.concat_ws(": ", "caption", named)).otherwise(named)
    return split.select("chunk_id", "table", F.col("row") + 1, shown.alias("title"), F.substring("line", 1, 500).alias("summary"), measured.alias("measured")).toDF("chunk_id", "table", "row", "title", "summary", "measured").where("size(measured) > 0").withColumn("title", F.substring("title", 1, 120))
