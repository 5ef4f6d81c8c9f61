"""What a graph view shows, on literal rows."""

import random

from pyspark.sql import functions as F

from factweave.operators import display, extraction, graph

N, E = "id string, label string, name string", "src string, dst string, type string, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    draw = random.Random(1)
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(0, 30)] + [(f"s{i}", "hub") for i in range(9)] + [(f"r{draw.randrange(40)}", f"r{draw.randrange(40)}") for _ in range(25)] + [(None, "x"), ("y", "y")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = graph.components(spark.createDataFrame(edges, "a string, b string"))
    assert rows(got.select("id", "component")) == sorted((x, root(x)) for x in parent)
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_shown_keepers(spark):
    nodes = [("1", "Material", "Nickel"), ("2", "Material", "никель"), ("3", "Material", "nickel matte"), ("4", "Material", "rich nickel matte"), ("5", "Material", "matted nickelware"), ("6", "Process", "nickel"), ("7", "Property", "Density: 7.5 t/m3"), ("8", "Property", "density"), ("9", "Document", "Nickel"), ("10", "Material", " - ")]
    edges = [("9", "3", "X", None), ("9", "3", "Y", None), ("3", "4", "X", None)]
    n, e = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    k = display.shown_keepers(n, e)
    # The shortest key takes in all that hold it; nickelware's words hold no word list of nickel's name in order.
    got = {r.id: r.keeper for r in k.collect()}
    assert got == {"1": "3", "2": "3", "3": "3", "4": "3", "5": got["5"], "6": "6", "7": "7", "8": "7"} | ({"10": "10"} if "10" in got else {})
    view, links = display.merged_view(n, e, k)
    shown = {r.id: r.aliases for r in view.collect()}
    assert "1" not in shown and set(shown["3"]) >= {"Nickel", "никель", "rich nickel matte"} and shown["9"] == []
    assert ("9", "3", "X", None) in rows(links) and all(r[0] != r[1] for r in rows(links))


def test_absorbed_keys_take_in_nothing(spark):
    """b_ore holds ore and is taken in by it; "b ore c" holds both; "zz b ore" too."""
    nodes = [("1", "Material", "oreb"), ("2", "Material", "oreb oreb"), ("3", "Material", "x oreb oreb y"), ("4", "Material", "zzz")]
    got = {r.id: (r.keeper, r.root) for r in display.shown_keepers(spark.createDataFrame(nodes, N), spark.createDataFrame([], E)).collect()}
    assert {i: r for i, (_, r) in got.items()} == {"1": "oreb", "2": "oreb", "3": "oreb", "4": "zzz"} and got["1"][0] == "3"


def test_reconciled(spark):
    n = spark.createDataFrame([("1", "M", "a", "k"), ("2", "M", "b", "k"), ("3", "M", "c", "l"), ("4", "P", "a", "k"), ("5", "M", "d", "")], "id string, label string, name string, canonical_key string")
    e = spark.createDataFrame([("3", "p", "HAS_PROPERTY", "7"), ("1", "p", "HAS_PROPERTY", "5"), ("2", "q", "HAS_PROPERTY", "6"), ("3", "r", "X", None)], E)
    k = display.reconciled(n, e, spark.createDataFrame([("2", "3")], "a string, b string"))
    assert rows(k.select("id", "keeper")) == [("1", "3"), ("2", "3"), ("3", "3"), ("4", "4"), ("5", "5")]
    assert rows(display.united_values(e, k)) == [("3", "p", "7"), ("3", "q", "6")]


def test_focus(spark):
    nodes = [("a", "Material", "copper ore"), ("b", "Material", "copper"), ("c", "Process", "melting"), ("t", "Team", "crew"), ("d", "Document", "report"), ("e", "Material", "tin"), ("f", "Material", "lone")]
    edges = [("a", "c", "X", None), ("c", "e", "X", None), ("e", "b", "X", None), ("a", "t", "X", None), ("t", "b", "X", None), ("d", "a", "X", None)]
    n, e = spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E)
    shown, links = display.focus(n, e, ["copper"])
    # The shorter way over the team is not allowed.
    assert rows(shown) == [("a", 86, True), ("b", 104, True), ("c", 0, False), ("e", 0, False)]
    assert rows(links) == [("a", "c", "path"), ("b", "e", "path"), ("c", "e", "path")]
    shown, links = display.focus(n, e, ["copper"], spark.createDataFrame([("t", 20)], "id string, points int"))
    # The path leads over a node that is not shown, so no link of it is.
    assert rows(shown.select("id")) == [("a",), ("b",)] and rows(links) == []
    shown, links = display.focus(n, e.where("src = 'd'"), ["copper"])
    assert rows(shown.select("id")) == [("a",), ("b",)] and rows(links) == [("a", "b", "chain")]
    # Under 42 points, the fallback of 30; a node without links.
    shown, _ = display.focus(n, e, ["nothing here"], spark.createDataFrame([("f", 31), ("e", 29)], "id string, points int"))
    assert rows(shown) == [("f", 31, True)]
    assert display.focus(n, e, ["nothing"])[0].count() == 0


def test_pages_and_expansion(spark):
    edges = spark.createDataFrame([("s1", "x1", "A", None), ("s1", "x2", "A", None), ("x3", "s1", "A", None), ("s1", "s2", "B", None), ("d", "x1", "M", None), ("d", "x2", "M", None), ("x3", "d", "M", None), ("s1", "far", "A", None), ("s1", "x1", "HAS_CHUNK", None)], E)
    seeds = spark.createDataFrame([("d", "s1"), ("d", "s2"), ("other", "s1")], "document string, id string")
    nodes, links = display.entity_pages(seeds, edges, most=2)
    assert rows(nodes) == [("d", "s1", True), ("d", "s2", True), ("d", "x1", False), ("d", "x2", False), ("other", "s1", True)]
    assert rows(links) == [("d", "s1", "s2", "B"), ("d", "s1", "x1", "A"), ("d", "s1", "x2", "A")]

    view = spark.createDataFrame([("d1", "Document", None, None, None), ("d2", "Document", None, None, None), ("cluster:d1:Material", "Cluster", "Material", "d1", None), ("cluster:d1:Process", "Cluster", "Process", "d1", None), ("m", "Material", None, "d1", "d1"), ("p", "Process", None, "d1", None), ("q", "Process", None, "d2", "d2")], "id string, label string, type string, hub string, document_id string")
    ties = spark.createDataFrame([("d1", "m"), ("d1", "p"), ("d2", "q"), ("m", "q")], "src string, dst string")
    docs = spark.createDataFrame([("d1",)], "id string")
    kept_nodes, kept_links = display.opened(view, ties, docs, spark.createDataFrame([("d1", "Material")], "document string, label string"))
    # p is linked by the open document itself.
    assert rows(kept_nodes.select("id")) == [("cluster:d1:Process",), ("d1",), ("d2",), ("m",), ("p",)] and rows(kept_links) == [("d1", "m"), ("d1", "p")]
    closed, none = display.opened(view, ties, docs.limit(0), spark.createDataFrame([], "document string, label string"))
    assert rows(closed.select("id")) == [("d1",), ("d2",)] and none.count() == 0
    left, links = display.without_documents(view, ties, docs)
    assert rows(left.select("id")) == [("d2",), ("q",)] and rows(links) == [("d2", "q")]


def test_values_and_questions(spark):
    cases = {"{'Ni': 1, 'Cu': '<  2'}": ("composition", "Ni 1 % · Cu <2 %"), "< 5,0": ("threshold", "< 5,0"), "1 – 2": ("range", "1 – 2"), "about 5": ("scalar", "about 5"), " ": ("scalar", "—"), "{bad": ("scalar", "{bad"), "{}": ("scalar", "{}")}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: (r.c.kind, r.c.shown) for r in df.select("v", display.value_class(F.col("v"), F.lit(" % ")).alias("c")).collect()}
    assert got == cases
    q = spark.createDataFrame([("What is the flow rate of nickel matte in heap leaching, abroad or в России?",)], "q string").select(display.parsed_query(F.col("q")).alias("p")).first().p
    assert (q.material, q.mode, q.property, q.geography) == ("nickel", "leaching", "flow rate", "domestic") and q.keywords == ["flow", "rate", "nickel", "matte", "heap", "leaching", "abroad", "россии"]


def test_experiment_union(spark):
    s = "document string, id int, name string, parameters map<string,string>, measured map<string,string>"
    old = spark.createDataFrame([("d", 1, "A ", {"t": "5", "status": "x"}, {"m": "1"}), ("d", 2, "a", {"t": "5"}, {"m": "1"})], s)
    new = spark.createDataFrame([("d", 3, "a", {"t": "5", "status": "y"}, {"m": "1"}), ("d", 4, "a", {"t": "6"}, {"m": "1"}), ("d", 5, "a", {"t": "6"}, {"m": "1"}), ("e", 6, "a", {"t": "5"}, {"m": "1"})], s)
    assert sorted(r.id for r in extraction.experiment_union(old, new, ["document"], ["id"]).collect()) == [1, 2, 4, 6]


def test_fuzzy_pairs_over_ranges(spark):
    """Neighbourhoods that cross the borders of ranges, against loops."""
    from difflib import SequenceMatcher

    from factweave.operators import entities

    draw = random.Random(1)
    nodes = [(f"i{i:03}", draw.choice("AB"), f"name of a thing number {draw.randrange(60)}{draw.choice(['', '.', 's'])}") for i in range(150)]
    got = {(r.a, r.b) for r in entities.fuzzy_pairs(spark.createDataFrame(nodes, N), reach=7).collect()}
    want = set()
    for label in "AB":
        order = sorted((name, i) for i, x, name in nodes if x == label)
        for k, (x, a) in enumerate(order):
            for y, b in order[k + 1 : k + 8]:
                ratio = SequenceMatcher(None, x, y).ratio()
                if ratio >= 0.96 and (x in y or y in x or ratio >= 0.985):
                    want.add((a, b))
    assert got == want and len(want) > 50
