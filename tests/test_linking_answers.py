"""Links of materials to processes, and answers as tables, on literal rows."""

import json

from pyspark.sql import functions as F

from factweave.operators import answers, linking

M = "doc_id long, seq int, name string, aliases array<string>, stage string"
P = "doc_id long, seq int, process_id string, name string, aliases array<string>, listed array<string>"


def links(spark, *cases):
    """The links of each case (materials, processes, text), a document for each."""
    materials = [(d, *m) for d, c in enumerate(cases) for m in c[0]]
    processes = [(d, *p) for d, c in enumerate(cases) for p in c[1]]
    texts = [(d, c[2]) for d, c in enumerate(cases)]
    df = linking.material_processes(spark.createDataFrame(materials, M), spark.createDataFrame(processes, P), spark.createDataFrame(texts, "doc_id long, text string"))
    found = df.collect()
    return [sorted((r.material, r.process_id, r.way) for r in found if r.doc_id == d) for d in range(len(cases))]


def test_links(spark):
    materials = [(0, "Copper matte", ["Stein"], None), (1, "Gypsum", None, None), (2, "Slag", [], None)]
    processes = [(0, "p0", "Smelting", [], [" stein "]), (1, "p1", "Slag cleaning", None, None), (2, "p2", "Washing", [], ["unknown"])]
    texts = [
        "gypsum " + "x" * 430 + " WASHING " + "y" * 450 + " copper",
        "gypsum " + "x" * 443 + "WASHING",  # wholly within 450 characters
        "gypsum " + "x" * 443 + " WASHING",  # one too far
        "washing " + "z" * 3000 + " gypsum washing",  # the second place of the process's name
    ]
    scored = [(0, "anolyte", [], None), (1, "rich anolyte", [], "product"), (2, "poor thing", [], "product"), (3, "thing", [], None), (4, "other", [], None)]
    offers = [(0, "p0", "electro refining", [], []), (1, "p1", "electrowinning refining", [], []), (2, "p2", "drying", [], [])]
    chain = [(0, "ab", [], None), (1, "abc", [], None), (2, "bc", [], None), (3, "zz", [], None)]
    cases = [(materials, processes, t) for t in texts] + [(scored, offers, ""), ([(0, "poor thing", None, "product")], offers[:1], None), (chain, [(0, "p0", "q", [], ["ab"])], None), (scored, [], "anolyte")]
    *near, by_score, last, related, none = links(spark, *cases)
    always = [("Copper matte", "p0", "listed"), ("Slag", "p1", "named")]
    assert [sorted(set(x) - set(always)) for x in near] == [[("Gypsum", "p2", "near")]] * 2 + [[]] + [[("Gypsum", "p2", "near")]] and all(set(always) <= set(x) for x in near)
    # anolyte: hints of p0 and p1 alike, the first counts.  rich anolyte: both words of its stage in p1.  thing: held by poor thing.
    assert by_score == [("anolyte", "p0", "score"), ("poor thing", "p1", "score"), ("rich anolyte", "p1", "score"), ("thing", "p1", "related")]
    assert last == [("poor thing", "p0", "last")]
    assert related == [("ab", "p0", "listed"), ("abc", "p0", "related"), ("bc", "p0", "related")]
    assert none == []


def objects(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "answer_id long, answer string")
    return df.select("answer_id", answers.answer_object(F.col("answer")).alias("object"))


def test_answer_objects(spark):
    texts = [
        '{"a": 1}', 'Here: {"a": {"b": 1,},} end', '```JSON\n{"a": None}\n```', 'x {"a": 1} and {"bb": "two", "c": "}{"} y', '{"materials": [{"name": "x"}, {"name": "yy"', "[1, 2]", None, "", "{“a”: True}", '{"a": "\\"}"} {',
    ]
    got = [r.object and json.loads(r.object) for r in objects(spark, texts).orderBy("answer_id").collect()]
    assert got == [{"a": 1}, {"a": {"b": 1}}, {"a": None}, {"bb": "two", "c": "}{"}, {"name": "x"}, None, None, None, {"a": True}, {"a": '"}'}]


def test_tables_of_answers(spark):
    said = {
        "materials": [
            {"name": "Fe2O3 / Ni ore", "aliases": ["rust"], "material_class": "Metal, ore", "state": "gas|film", "properties": {"a": {"value": "2-4"}, "b": {"value_min": "3"}, "c": {}, "d": None, "e": {"value": {"Ni": "<1", "Cu": None}}, "f": {"source_text": "some"}, "g": {"value": 7, "unit": "t"}}},
            {"name": "alloy"}, {"name": None}, "text",
        ],
        "experiments": [{"material_name": "..."}, {"material_name": "медь - Copper", "regime": {"name": "Leach test"}, "measured_properties": {"x": {"value": "1"}}}],
        "processes": ["Leaching; Washing", {"name": "leaching", "materials": ["n/a", " ore "]}, "process", {"name": "Drying", "aliases": ["D", ""], "materials": ["...", "ore"]}],
        "equipment": [{"name": "Pump"}, "pump", "device"],
        "facilities": [{"name": "Works A", "country": "<country>", "facility_type": "MINE"}, {"name": "works a"}, "no object"],
        "experts": [{"name": "Lee, Ann", "field": "area"}, {"name": "Ann Lee"}, {"name": "Copper Matte"}],
    }
    o = objects(spark, [json.dumps(said), '{"materials": "none"}'])
    got = answers.materials(o).orderBy("part").collect()
    assert [(r.part, r.name, r.aliases, r.material_class, r.state) for r in got] == [(0, "Fe2O3", ["rust"], "metal", "film"), (1, "Ni ore", [], None, "film")]
    values = {p.name: (p.value, p.low, p.high, p.unit, p.composition) for p in got[0].properties}
    assert values == {"a": ("3.0", 2.0, 4.0, None, None), "b": ("3.0", 3.0, None, None, None), "e": ('{"Ni":"<1"}', None, None, None, {"Ni": "<1"}), "f": ("some", None, None, None, None), "g": ("7", None, None, "t", None)}
    assert [(r.material, r.regime_type, r.measured[0].value) for r in answers.experiments(o).collect()] == [("Copper", "chemical", "1")]
    assert sorted((r.name, r.aliases, r.materials) for r in answers.processes(o).collect()) == [("Drying", ["D"], ["ore"]), ("Leaching", [], []), ("Washing", [], [])]
    assert [r.name for r in answers.equipment(o).collect()] == ["Pump"]
    assert [(r.name, r.country, r.facility_type) for r in answers.facilities(o).collect()] == [("Works A", None, "mine")]
    assert [(r.name, r.field) for r in answers.experts(o).collect()] == [("Ann Lee", None)]


def test_table_experiments(spark):
    from factweave.operators import extraction

    text = "a [TABLE]\nSoil\n| Material | E, MPa | ν | Note |\n|---|---|---|---|\n| Clay | 12,5 | 0.3 | 7 |\n| | <5 | | |\n| Sand | none | - | 1 |\n[/TABLE] b [TABLE]| x | y |\n|-|-|\n| 1 | 2 |[/TABLE]"
    rows = extraction.table_experiments(spark.createDataFrame([(1, text), (2, "no table"), (3, None)], "chunk_id int, text string")).orderBy("row").collect()
    assert [(r.chunk_id, r.table, r.row, r.title, [tuple(m) for m in r.measured]) for r in rows] == [
        (1, 0, 1, "Soil: Clay", [("elastic_modulus", "12.5", "MPa"), ("poisson_ratio", "0.3", "")]), (1, 0, 2, "Soil", [("elastic_modulus", "<5", "MPa")]),
    ]


def test_listed_names_in_capitals_with_sharp_s(spark):
    none = "array<string>"
    materials = spark.createDataFrame([(1, 1, "weißmetall", [], None), (1, 2, "große", [], None), (1, 3, "grosse", [], None)], f"doc_id long, seq int, name string, aliases {none}, stage string")
    processes = spark.createDataFrame([(1, 1, "p", "zzz", [], ["WEISSMETALL", "Große", "GROSSE"])], f"doc_id long, seq int, process_id string, name string, aliases {none}, listed {none}")
    texts = spark.createDataFrame([(1, "")], "doc_id long, text string")
    got = linking.material_processes(materials, processes, texts)
    assert {(r.material, r.way) for r in got.collect()} == {("weißmetall", "listed"), ("große", "listed"), ("grosse", "listed")}
