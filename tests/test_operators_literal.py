"""Operators on literal rows, with results worked out by hand."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from factweave.functions import questions as Q
from factweave.functions import text as T
from factweave.operators import analytics, context, entities, extraction, graph, ingest, lookup, retrieval, upserts
from factweave.sources import html


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_decisions(spark):
    stored = spark.createDataFrame([(1, "a", "h1", "f1", "x", 1), (2, "b", "h2", "f2", "y", 1), (3, "a", None, "f3", "z", 0)], "id long, source string, content_hash string, file_hash string, file_path string, created_at long")
    come = spark.createDataFrame([("same", "a", "h1", "f9", "n"), ("changed", "a", "h2", "f2", "n"), ("known text", "q", "h2", "f8", "x"), ("new", "q", "h9", "f8", "n")], "name string, source string, content_hash string, file_hash string, file_path string")
    assert rows(ingest.decide(come, stored)) == [("changed", "replace", 1), ("known text", "skip", 2), ("new", "create", None), ("same", "skip", 1)]
    assert rows(ingest.decide_file(come, stored)) == [("changed", "skip", 2), ("known text", "skip", 1), ("new", "create", None), ("same", "skip", 1)]
    assert rows(ingest.consolidated(stored, "source")) == [(3, 1)]


def test_cascade_orphans_and_gaps(spark):
    nodes = spark.createDataFrame([("d1", "Document"), ("d2", "Document"), ("e1", "Experiment"), ("m1", "Material"), ("m2", "Material"), ("m3", "Material"), ("t1", "Team"), ("x1", "Expert"), ("c1", "DocumentChunk"), ("p1", "Process"), ("r1", "Property")], "id string, label string")
    edges = spark.createDataFrame(
        [("e1", "d1", "DESCRIBED_IN"), ("e1", "d2", "DESCRIBED_IN"), ("d1", "m1", "MENTIONS_MATERIAL"), ("d1", "m2", "MENTIONS_MATERIAL"), ("d2", "m2", "MENTIONS_MATERIAL"), ("e1", "m1", "USES_MATERIAL"), ("t1", "d1", "AUTHORED"), ("x1", "t1", "MEMBER_OF"), ("d1", "c1", "HAS_CHUNK"), ("m1", "p1", "PROCESSED_IN"), ("e1", "r1", "MEASURED"), ("m2", "r1", "HAS_PROPERTY")],
        "src string, dst string, type string",
    )
    left, links = graph.cascade_delete(nodes, edges, "d1")
    assert [r.id for r in left.orderBy("id").collect()] == ["d2", "m2", "m3", "p1", "r1", "x1"]
    assert rows(links) == [("d2", "m2", "MENTIONS_MATERIAL"), ("m2", "r1", "HAS_PROPERTY")]
    assert [r.id for r in graph.orphans(nodes, edges).orderBy("id").collect()] == ["m3"]
    assert [r.id for r in graph.orphans(left, links).orderBy("id").collect()] == ["m3", "p1", "x1"]
    found = analytics.gaps(nodes.where("label = 'Material'").withColumn("name", F.col("id")), nodes.where("label = 'Experiment'").withColumn("regime_name", F.col("id")), edges.where("type <> 'MEASURED'"), spark.createDataFrame([("r1", "mechanical")], "id string, category string"))
    assert [(g, i) for g, i, _ in rows(found)] == [("no_experiments", "m2"), ("no_experiments", "m3"), ("no_measured_properties", "e1"), ("no_mechanical_properties", "m1"), ("no_mechanical_properties", "m3")]
    assert graph.unlinked(edges, "d1", ("HAS_CHUNK",)).count() == len(edges.collect()) - 2
    assert rows(graph.purge(nodes, ["Team", "Image"])[1]) == [("Team", 1)]


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("a", "d", "x"), ("d", "c", "x"), ("c", "e", "x")], "src string, dst string, type string")
    every = spark.createDataFrame([(i,) for i in "abcdef"], "id string")
    assert rows(graph.shortest_paths(edges, "a", every, 3)) == [("a", 0, ["a"]), ("b", 1, ["a", "b"]), ("c", 2, ["a", "b", "c"]), ("d", 1, ["a", "d"]), ("e", 3, ["a", "b", "c", "e"])]
    assert rows(graph.shortest_paths(edges, "a", every.where("id = 'c'"), 3, every.where("id <> 'b'"))) == [("c", 2, ["a", "d", "c"])]
    assert rows(graph.nearest(edges, spark.createDataFrame([("b",), ("e",)], "id string"), 2)) == [("a", "b", 1), ("b", "b", 0), ("c", "b", 1), ("d", "b", 2), ("e", "e", 0)]
    assert rows(graph.reach(edges, every.where("id = 'a'"), 4)) == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 3)]


def test_search_by_value_and_place(spark):
    assert [analytics.geography("RU", F.lit(s), F.lit(c)) is not None for s, c in [("x", "y")]] == [True]
    one = lambda w, s, c: spark.range(1).select(analytics.geography(w, F.lit(s), F.lit(c)).alias("x")).first().x
    assert one("Russia", "", "RU") and one("domestic", "Domestic", "x") and not one("domestic", None, "Peru") and one("abroad", "global", "") and not one("local", "domestic", "") and one("er", "", "Peru")
    none = F.lit(None).cast("string")
    tables = {
        "materials": spark.createDataFrame([("m", "Iron")], "id string, name string").withColumns({"material_class": F.lit("metal"), "aliases": F.array(F.lit("Fe"))}),
        "documents": spark.createDataFrame([("d", 2000)], "id string, year int").withColumns({"scope": none, "country": F.lit("Peru")}),
        "processes": spark.createDataFrame([("p", "Smelting")], "id string, name string"),
        "experiments": spark.createDataFrame([("e1", "acid leach", "chemical"), ("e2", "x", "y")], "id string, regime_name string, regime_type string").withColumn("status", F.lit("ongoing")),
        "edges": spark.createDataFrame([("e1", "m", "USES_MATERIAL"), ("e2", "m", "USES_MATERIAL"), ("e1", "d", "DESCRIBED_IN"), ("e2", "p", "USES_PROCESS")], "src string, dst string, type string"),
        "measured": spark.createDataFrame([("e1", "prop:yield_strength", "12,5 MPa"), ("e2", "prop:density", "x")], "src string, dst string, value string"),
    }
    find = lambda **k: [r.experiment_id for r in analytics.structured_search(SimpleNamespace(**tables), **k).orderBy("experiment_id").collect()]
    assert find() == ["e1", "e2"] and find(process="leach") == ["e1"] and find(process="CHEM") == ["e1"] and find(process="smelt") == ["e2"] and find(low=12) == ["e1"] and find(prop="strength") == ["e1"] and find(prop="s", high=12) == [] and find(material="fe", place="per") == ["e1"]


def test_merge_and_upserts(spark):
    stored = spark.createDataFrame([("k", "old", ["a"], "metal")], "key string, name string, aliases array<string>, material_class string")
    change = spark.createDataFrame([("k", "n1", ["b"], None, 1), ("k", "n2", ["c", "a"], "ore", 2), ("z", "z", None, None, 1)], "key string, name string, aliases array<string>, material_class string, seq int")
    assert rows(upserts.merge_nodes(stored, change, "key", ["name"], ["aliases"], "seq")) == [("k", "n2", ["a", "b", "c"], "metal"), ("z", "z", [], None)]
    new = spark.createDataFrame([("e", "r", "m", None, {"status": "planned", "t": "5"}, {"q": "1"}), ("f", "s", None, "d", {}, {})], "id string, regime_name string, material string, document string, parameters map<string,string>, measured map<string,string>")
    nodes, edges = upserts.experiment_upsert(spark.createDataFrame([("f", "old", "ongoing")], "id string, regime_name string, status string"), new)
    assert rows(nodes) == [("e", "r", "planned"), ("f", "s", "completed")]
    assert [(r.src, r.dst, r.type, r.value) for r in edges.orderBy("src", "dst").collect()] == [("e", "m", "USES_MATERIAL", None), ("e", "param:status", "HAS_REGIME_PARAM", "planned"), ("e", "param:t", "HAS_REGIME_PARAM", "5"), ("e", "prop:q", "MEASURED", "1"), ("f", "d", "DESCRIBED_IN", None)]
    docs, chunks = upserts.document_upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string"), spark.createDataFrame([("1:0", 1, 0, "x"), ("2:0", 2, 0, "y")], "chunk_id string, id long, chunk_index int, text string"), spark.createDataFrame([(2, "B", ["p", " ", "q"])], "id long, title string, texts array<string>"))
    assert rows(docs) == [(1, "a"), (2, "B")] and rows(chunks) == [("1:0", 1, 0, "x"), ("2:0", 2, 0, "p"), ("2:2", 2, 2, "q")]
    figures = spark.createDataFrame([(1, "k1", "plot"), (1, "k1", "plot"), (1, "k2", "table")], "doc_id long, storage_key string, image_type string")
    old = spark.createDataFrame([(1, "x"), (2, "[]")], "doc_id long, items_json string")
    assert rows(upserts.gallery_items(figures, old)) == [(1, '[{"storage_key":"k1","image_type":"plot"},{"storage_key":"k2","image_type":"table"}]'), (2, "[]")]


def test_resolution(spark):
    stored = spark.createDataFrame([(1, "Nickel", ["Ni"], "nickel"), (2, "old grey granite", ["gg"], "x1"), (3, "basalt stone", [], "x2"), (4, "limestones", [], "x3")], "id long, name string, aliases array<string>, canonical_key string")
    new = spark.createDataFrame([("никель", []), ("Basalt_Stone", []), ("basalt stone", []), ("granite", ["GG"]), ("limestone", []), ("quartz", [])], "name string, aliases array<string>")
    assert rows(entities.resolve(new, stored)) == [("Basalt_Stone", None, "new"), ("basalt stone", 3, "exact"), ("granite", 2, "alias"), ("limestone", 4, "fuzzy"), ("quartz", None, "new"), ("никель", 1, "canonical")]
    names = ["Heap leaching of ore in Kola region", "Heap leaching of ore in Kola region.", "Heap leaching of oxe in Kola region", "Zinc"]
    nodes = spark.createDataFrame([(i, "Process", n) for i, n in enumerate(names)], "id long, label string, name string")
    assert [(r.a, r.b) for r in entities.fuzzy_pairs(nodes).orderBy("a", "b").collect()] == [(0, 1)]
    merged = spark.createDataFrame([("k", 1, "a", ["x"], "other", 1), ("k", 2, "b", ["y", "x"], "alloy", 2), ("k", 3, "c", [], "ore", 3)], "canonical_key string, id long, name string, aliases array<string>, material_class string, seq int")
    assert rows(entities.merged_materials(merged)) == [("k", 1, "c", ["x", "y"], "alloy")]
    shown = spark.createDataFrame([("a", "Material", "Copper ores"), ("b", "Material", "ore, copper"), ("c", "Process", "copper ore")], "id string, label string, name string")
    assert rows(entities.display_keepers(shown, spark.createDataFrame([("b", 3)], "id string, degree int"))) == [("a", "b"), ("b", "b"), ("c", "c")]
    score = lambda name, label, *p: spark.range(1).select(entities.node_score(F.lit(name), F.lit(name), F.lit(label), list(p)).alias("x")).first().x
    assert [score("Zinc", "Material", "zinc"), score("zinc removal", "Process", "removal"), score("zinc", "Process", "of zinc"), score("an ore", "Document", "ore"), score("x", "Process", "zinc"), score("zinc removal", "Process", "a zinc removal b")] == [104, 82, 0, 24, 0, 78]


def test_lookups(spark):
    nodes = spark.createDataFrame([("a", "Material", "Iron"), ("b", "Process", "smelting"), ("d", "Document", "Doc")], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "PROCESSED_IN"), ("a", "b", "PROCESSED_IN"), ("d", "a", "MENTIONS_MATERIAL")], "src string, dst string, type string")
    assert [tuple(r) for r in lookup.connections(nodes, edges, "a").collect()] == [("d", "Document", "Doc", "MENTIONS_MATERIAL", "in"), ("b", "Process", "smelting", "PROCESSED_IN", "out")]
    assert lookup.visual_edges(edges, nodes).count() == 2
    got = lookup.page(nodes, ["id"], 1, 1).collect()
    assert [(r.id, r.total, r.has_more) for r in got] == [("b", 3, True)]
    people = spark.createDataFrame([(1, "Smith, John"), (2, "Ann Lee")], "id long, name string")
    teams = spark.createDataFrame([("t", ["John Smith", "Bob Ray"])], "id string, members array<string>")
    assert rows(lookup.experts_in_teams(people, teams)) == [(1, "t")]
    keyed = spark.createDataFrame([("1", "Nickel", "nickel"), ("2", "Old Rock", "")], "id string, name string, canonical_key string")
    assert rows(lookup.material_by_key(keyed, spark.createDataFrame([("никель",), ("old rock",), ("x",)], "name string"))) == [("old rock", "2"), ("x", None), ("никель", "1")]


def test_scope_and_answers(spark):
    ranked = spark.createDataFrame([("a:1", 1, 2.0, 1, "Birch"), ("b:1", 2, 1.9, 2, "Oak trees report"), ("a:2", 1, 0.1, 3, None)], "chunk_id string, doc_id long, score double, rank int, title string")
    docs = spark.createDataFrame([(1, "Birch"), (2, "Oak trees report"), (3, "Unseen larch")], "id long, title string")
    scope = lambda q, **k: (lambda m, r, d: (m, r, sorted(x.id for x in d.collect())))(*retrieval.document_scope(q, ranked, docs, **k))
    assert scope("about birch") == ("explicit", "title_in_query", [1])
    assert scope("oak trees and unseen larch") == ("multi", "multiple_titles_in_query", [2, 3])
    assert scope("in all documents") == ("aggregate", "aggregate_query", [1, 2, 3])
    assert scope("compare them") == ("multi", "comparison_query", [1, 2])
    assert scope("x") == ("single", "primary_relevance", [1]) and scope("x", forced="3")[0] == "explicit"
    assert retrieval.needs_choice(retrieval.document_scores(ranked)).first().ambiguous
    chunks = spark.createDataFrame([("c1", "No number here. But ore 5 kg is. And 7. Ore and ore 8 too."), ("c2", "Plain text. Of ore."), ("c3", "x" * 800)], "chunk_id string, text string")
    assert rows(retrieval.best_sentences(chunks, ["ore"], 2)) == [("c1", "But ore 5 kg is. Ore and ore 8 too."), ("c2", "Of ore. Plain text."), ("c3", "x" * 700 + "…")]
    rank = lambda ids: spark.createDataFrame([(x, i + 1, 1 - i / 10) for i, x in enumerate(ids)], "chunk_id string, rank int, score double")
    pool = {r.chunk_id: r for r in retrieval.candidate_pool({"vector": rank("ab"), "keyword": rank("bc"), "vector:2": rank("b")}).collect()}
    assert pool["b"].sources == ["keyword", "vector"] and pool["b"].vector_score == 1.0 and pool["b"].rrf == pytest.approx(1 / 62 + 1 / 61 + 1 / 61) and pool["c"].vector_score is None
    assert [retrieval.cap_for(8, n) for n in (None, 1, 3, 4)] == [2, 8, 4, 2]


def test_context(spark):
    text = "a" * 600 + " nickel 5 million tonnes " + "b" * 2000
    got = context.compressed_text(text, ["nickel", "million"], 500)
    assert "nickel 5 million tonnes" in got and got.startswith("…") and got.endswith("…") and len(got) <= 502
    assert context.compressed_text("short", ["x"], 500) == "short" and context.compressed_text("z" * 600, ["q"], 500) == "z" * 500 + "…" and context.compressed_text(None, [], 5) == ""
    assert context.context_terms("Global production of Ni", ["ni"], ["5"]) == ["ni", "worldwide", "produced worldwide", "world production", "5"]
    ranked = spark.createDataFrame([(f"c{i}", i, float(i), "w" * 1000, ["keyword"]) for i in range(6)], "chunk_id string, rank int, score double, text string, sources array<string>")
    kept = lambda n, **k: [(r.chunk_id, len(r.text)) for r in context.within_context(ranked, ["w"], n, **k).orderBy("rank").collect()]
    assert [c for c, _ in kept(9000, each=1000)] == [f"c{i}" for i in range(6)]
    assert [c for c, _ in kept(4400, each=1000)] == ["c2", "c3", "c4", "c5"]
    assert [c for c, _ in kept(2000, each=1000)] == ["c3", "c4", "c5"] and max(n for _, n in kept(2000, each=1000)) < 700
    rows_ = spark.createDataFrame([(1, 1, "d1", "One", "x"), (1, 2, "d2", None, "y"), (1, 3, "d1", "One", "z")], "answer_id int, rank int, doc_id string, title string, text string")
    assert context.assembled(rows_).first().context == "## One\n[1] x\n[3] z\n\n## Document\n[2] y"


def test_extraction(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(extraction.processes(F.lit("Метод конечного элемента, FEM and leaching"))) == ["finite_element_method", "leaching"]
    assert [one(extraction.process_label(F.lit(n))) for n in ("heap leaching", "process", "rope", "…", "numerical model")] == [True, False, False, False, True]
    assert [one(extraction.template(F.lit(n))) for n in ("<name>", "TBD", "a...b", "x", "Nickel")] == [True, True, True, True, False] and one(extraction.placeholder(F.lit("Device "), "equipment"))
    assert tuple(one(extraction.place(F.lit("n/a"), F.lit("Global")))) == (None, "global") and tuple(one(extraction.place(F.lit("Peru"), F.lit("x")))) == ("Peru", None) and one(extraction.reliability(F.lit("patent"))) == 0.85
    found = extraction.facts(F.lit('text {"facts": [{"claim": " A ", "sources": ["2", "1", "2"]}, {"claim": "", "sources": ["1"]}, {"text": "B", "sources": ["x"]}]} end'))
    assert one(extraction.fact_lines(found)) == "1. A [1][2]" and one(extraction.facts(F.lit("no json"))) == [] and len(one(extraction.facts(F.lit('[{"text": "B", "sources": ["3"]}]')))) == 1
    claim = lambda t: extraction.facts(F.lit('[{"claim": "%s", "sources": ["1"]}]' % t))
    asks = lambda q, t: one(extraction.addresses(F.lit(q), claim(t)))
    assert asks("how many of 5", "it is 7") and not asks("how many of 5", "it is so") and not asks("when was nickel found", "nickel was found") and asks("when was nickel found", "nickel in 1951") and not asks("what of nickel", "copper is") and not asks("the harm of nickel", "nickel is")
    taxonomy = spark.createDataFrame([("metal", 2, "nickel", False), ("alloy", 1, "steel", False), ("alloy", 1, "nickel steel", True), ("ore", 0, "ni", True)], "class string, rank int, term string, alias boolean")
    names = spark.createDataFrame([("Nickel",), ("nickel steel",), ("rope",), ("n",)], "name string")
    assert rows(extraction.inferred_classes(names, taxonomy)) == [("Nickel", "metal"), ("n", "other"), ("nickel steel", "alloy"), ("rope", "other")]
    stages = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "other")], "class string, stage string")
    assert rows(extraction.class_siblings(stages)) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c")]
    findings = spark.createDataFrame([(1, 1, "of copper"), (2, 1, "of Ni"), (3, 1, "of none")], "finding_id int, doc_id int, text string")
    of_doc = spark.createDataFrame([(1, "m1", "zinc", ["Zn"], 0), (1, "m2", "Copper", [], 1), (1, "m3", "nickel", ["ni"], 2)], "doc_id int, material_id string, name string, aliases array<string>, seq int")
    assert rows(extraction.finding_material(findings, of_doc)) == [(1, "m2"), (2, "m3"), (3, "m1")]
    table = spark.createDataFrame([("c", "[TABLE]| z | Ni, % | t |\n|---|---|---|\n| a | <0,5 % | - |\n| b | 7 | x9 |[/TABLE]")], "chunk_id string, text string")
    assert rows(extraction.table_rows(table)) == [("c", 0, 1, "Ni, %", "a", 0.5), ("c", 0, 2, "Ni, %", "b", 7.0)]
    passes = spark.createDataFrame([("k", 1, " ", "a", ["x"]), ("k", 2, "p", "b", ["y"]), ("k", 3, "q", None, [])], "key string, seq int, f string, l string, v array<string>")
    assert rows(extraction.merged_passes(passes, ["key"], ["f"], ["l"], ["v"])) == [("k", "p", "b", ["x", "y"])]
    assert rows(extraction.unique_rows(passes, {"k": F.upper("key")}, ["seq"]))[0][1] == 1
    assert one(T.unique_names(F.array(*map(F.lit, ("Ann  Lee", "ann lee", "", "Bob"))))) == ["Ann Lee", "Bob"]
    grid = F.array(F.array(F.lit("a &amp;lt; b"), F.lit("v")), F.array(F.lit(""), F.lit(" ")), F.array(F.lit("x<br>y"), F.lit("5")))
    assert one(T.grid_markdown(grid)) == "| a < b | v |\n| --- | --- |\n| x y | 5 |" and one(T.grid_quality(grid)) == pytest.approx(0.72 + 0.02 + 0.15 / 4) and one(T.grid_quality(F.array(F.array(F.lit("a"))))) == 0
    r = one(Q.parsed_rewrite(F.lit('x {"keywords": ["a"]} {"search_query": " s ", "keywords": ["a", " "]}')))
    assert (r.search_query, r.search_query_en, r.keywords) == ("s", "", ["a"]) and one(Q.parsed_rewrite(F.lit("none"))) is None


def test_pages(spark):
    long = "An abstract that is long enough to count, as it has more than eighty characters in it."
    page = f"""<html><head><title> </title><meta property="og:title" content="Og"><meta name="description" content="{long}"><script>x<p>no</p></script></head><body><p>outside</p><main><p>in main</p><article><h1></h1>
<p>one<p>two &amp; more</p><h2>Part</h2><ul><li>a</li><li>b</li></ul><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table><aside><p>ad</p></aside></article></main></body></html>"""
    assert list(html.chunks_of(page)) == [("Abstract", long), (None, "one\ntwo & more"), ("Part", "a\nb\nh | k\n1 | 2")]
    assert [len(t.split("\n")) for _, t in html.chunks_of("".join(f"<p>{i}</p>" for i in range(7)))] == [5, 2] and list(html.chunks_of(None)) == []
    one = lambda f, *x: spark.range(1).select(f(*map(F.lit, x)).alias("x")).first().x
    assert one(html.title, page, "http://a.org/p/q?x") == "Og" and one(html.title, "<b>", "http://a.org/p/q?x") == "/p/q" and one(html.year, '<time datetime="1999-01">') == 1999 and one(html.year, "<p>") is None
    assert one(html.authors, '<address>A <b>B</b></address><meta property="article:author" content="C">') == ["A B", "C"]


def test_titles_tables_and_chains(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    none = F.lit(None).cast("string")
    paragraphs = F.array(F.lit("short"), F.lit("J. Smith"), F.lit("A study of the rope and its ends"))
    assert one(extraction.resolved_title(F.lit("Acme Group"), none, paragraphs, F.lit("a_b.docx"))) == "A study of the rope and its ends"
    assert one(extraction.resolved_title(none, F.lit(" On rope "), paragraphs, F.lit("x"))) == "On rope" and one(extraction.resolved_title(none, none, F.array().cast("array<string>"), F.lit("a_b.docx"))) == "a b"
    boxes = [(1, 1, 0, 0, 10, 10, 0.5, "a"), (1, 1, 1, 1, 9, 9, 0.9, "b"), (1, 1, 20, 0, 30, 10, 0.1, "c"), (1, 2, 0, 0, 10, 10, 0.5, "d")]
    tables = spark.createDataFrame([(*b[:2], *map(float, b[2:7]), b[7]) for b in boxes], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double, quality double, text string")
    assert sorted(r.text for r in extraction.distinct_tables(tables).collect()) == ["b", "c", "d"]
    chain = spark.createDataFrame([("c", "a"), ("b", "c"), ("b", "d")], "src string, dst string").withColumn("type", F.lit("x"))
    assert rows(graph.chain_order(chain), "place") == [("a", 0), ("c", 1), ("b", 2), ("d", 3)]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string").withColumn("type", F.lit("x"))
    assert graph.chain_order(ring).count() == 0


def test_experiments_and_bullets(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(extraction.experiments(F.lit("Численный эксперимент и полевые испытания"))) == ["numerical_experiment", "field_experiment"] and one(extraction.experiments(F.lit("E = 5,5 ГПа"))) == ["inline_parameters"] and one(extraction.experiments(F.lit("rope"))) == []
    assert [tuple(x) for x in one(extraction.inline_numbers(F.lit("модуль упругости: 210 GPa, ν=0.3; density = 7,8.")))] == [("elastic_modulus", 210.0, "GPa"), ("poisson_ratio", 0.3, None), ("density", 7.8, "kg/m3")]
    assert one(extraction.experiment_label(F.lit("Field test run"))) and not one(extraction.experiment_label(F.lit("rope"))) and not one(extraction.experiment_label(F.lit("study")))
    maps = lambda d: F.create_map(*(F.lit(x) for p in d.items() for x in p)) if d else F.create_map().cast("map<string,string>")
    assert one(extraction.experiment_fingerprint(F.lit(" Leach "), maps({"t": "5", "status": "x", "a": "1"}), maps({"q": "2"}))) == "leach|a=1|t=5|q=2"
    answers = spark.createDataFrame([(1, "Facts:\n1. Heap Leaching [1]\n2. Zinc Removal [2]\n3. Ore [1] [2]\n4. Leaching of 5 t [9]\n5. Copper Matte [3]"), (2, "1. Alone [1]")], "answer_id int, answer string")
    texts = spark.createDataFrame([(1, 1, "They tried heap leaching of ore for a long while, and it worked out well."), (1, 2, "Zinc Removal\nScope\nAim"), (1, 3, "nothing here")], "answer_id int, n int, text string")
    assert rows(extraction.pruned_bullets(answers, texts)) == [(1, "Facts:\n1. Heap Leaching [1]\n4. Leaching of 5 t [9]"), (2, "")]
    assert rows(extraction.pruned_bullets(answers, texts, ["gold"])) == [(1, "Facts:\n4. Leaching of 5 t [9]"), (2, "")]
