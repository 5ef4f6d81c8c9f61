"""The graph's branches: nothing is written but items and pairs, edges meet by their type, and searches end with the last pair."""

from factweave.operators import graph
from factweave.plans import corpus_graph
from factweave.plans.corpus_graph import ENDS, Corpus

E = "src string, dst string, type string, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_are_not_stored(spark):
    c = Corpus(spark, "/root/testdata/sf0.001")
    edges, nodes = c.edges, c.nodes
    names = {name for _, folder, name in corpus_graph._STORED if folder == c.folder}
    assert not names & {"edges", "nodes"} and edges.count() > 0 and nodes.count() > 0


def test_once(spark):
    c = Corpus(spark, "/root/testdata/sf0.001")
    for columns in (["src", "dst", "type"], ["src", "dst", "type", "value"]):
        once = c.once(*columns)
        assert once.count() == once.distinct().count() and not once.exceptAll(c.edges.select(*columns).distinct()).count()
        assert once.count() == c.edges.select(*columns).distinct().count()


def test_redirect_by_labels(spark):
    edges = spark.createDataFrame([("e1", "m2", "USES_MATERIAL", None), ("e1", "m1", "USES_MATERIAL", None), ("d1", "m2", "MENTIONS_MATERIAL", None), ("t1", "d1", "AUTHORED", None), ("t1", "d1", "AUTHORED", None)], E)
    keepers = spark.createDataFrame([("m2", "m1", "Material"), ("m1", "m1", "Material")], "id string, keeper string, label string")
    assert rows(graph.redirect(edges, keepers, ENDS)) == rows(graph.redirect(edges, keepers.drop("label"))) == [("d1", "m1", "MENTIONS_MATERIAL", None), ("e1", "m1", "USES_MATERIAL", None), ("t1", "d1", "AUTHORED", None)]


def test_untouched(spark):
    edges = spark.createDataFrame([("e1", "d1", "DESCRIBED_IN", None), ("e2", "d2", "DESCRIBED_IN", None), ("d1", "m1", "MENTIONS_MATERIAL", None), ("e1", "m1", "USES_MATERIAL", None)], E)
    gone = spark.createDataFrame([("d1",)], "id string")
    assert rows(graph.untouched(edges, gone, Corpus.touching("Document"))) == rows(graph.untouched(edges, gone)) == [("e1", "m1", "USES_MATERIAL", None), ("e2", "d2", "DESCRIBED_IN", None)]


def test_last_step_goes_to_starts_alone(spark):
    edges = spark.createDataFrame([("a", "x", "T", None), ("x", "b", "T", None), ("a", "c", "T", None), ("c", "b", "T", None), ("z", "b", "T", None), ("q", "r", "T", None)], E)
    ends = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    assert rows(graph.paths_between(edges, ends, 5)) == [("a", "b", ["a", "c", "b"]), ("a", "z", ["a", "c", "b", "z"]), ("b", "z", ["b", "z"])]
    allowed = spark.createDataFrame([("x",)], "id string")
    assert rows(graph.paths_between(edges, ends, 5, allowed)) == [("a", "b", ["a", "x", "b"]), ("a", "z", ["a", "x", "b", "z"]), ("b", "z", ["b", "z"])]
    assert rows(graph.paths_between(edges, ends.where("id <> 'b'"), 1)) == []


def test_answers_are_read_in_many_tasks(spark):
    from factweave import queries_linking

    parts = queries_linking._answers(Corpus(spark, "/root/testdata/sf0.001"))
    assert parts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_items_of_documents(spark):
    """Opened documents meet no items of others: those are not stored for it, and hold what the stored ones hold."""
    from factweave import queries_display

    c = Corpus(spark, "/root/testdata/sf0.001")
    docs = c.documents.where("scope = 'domestic'").select("id")
    nodes, links = queries_display._view(c, docs)
    assert nodes.where("label = 'Experiment'").join(docs.select(docs.id.alias("hub")), "hub", "left_anti").isEmpty()
    for mine, whole in zip((nodes, links), queries_display._view(c)):
        assert mine.exceptAll(whole).isEmpty()
    assert mine.count() < whole.count()


def test_opened_strays(spark):
    """An open document that the view does not have stays out, and only what stays by itself is reached from it."""
    from factweave.operators import display

    view = spark.createDataFrame([("d1", "Document", None, None), ("c", "Cluster", "M", "d1"), ("m", "M", None, "d1"), ("n", "N", None, "x"), ("o", "N", None, None), ("z", None, None, "d1"), ("y", None, None, None)], "id string, label string, type string, hub string")
    links = spark.createDataFrame([("d1", "o"), ("y", "d1"), ("x", "o"), ("m", "n"), ("x", "m"), ("m", "x"), ("n", "x")], "src string, dst string")
    docs = spark.createDataFrame([("d1",), ("x",), ("m",), ("m",), ("e",)], "id string")
    types = spark.createDataFrame([("d1", "M"), ("d1", "M"), ("d1", None)], "document string, label string")
    shown, ties = display.opened(view, links, docs, types)
    assert rows(shown.select("id")) == [("d1",), ("m",), ("n",), ("o",), ("y",)]
    assert rows(ties) == sorted([("d1", "o"), ("y", "d1"), ("x", "o"), ("m", "n"), ("x", "m"), ("m", "x"), ("n", "x")])
