"""Links are counted for the labels asked; names that hold one another meet by the whole of the shorter one."""

from factweave.operators import display, graph
from factweave.plans.corpus_graph import Corpus


def test_ends_hold_the_links_of_their_labels_alone(spark):
    c = Corpus(spark, "/root/testdata/sf0.001")
    for labels in (("Material",), ("Process", "Team", "Property")):
        ids = c.nodes.where(c.nodes.label.isin(*labels)).select("id")
        counted = graph.degrees(c.ends(*labels)).where("id IS NOT NULL")
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, graph.degrees(c.edges).join(ids, "id", "left_semi").collect()))
    assert set(graph.degrees(c.ends("Team")).toDF("id", "n").selectExpr("left(id, 2) AS p").distinct().toPandas().p.dropna()) == {"t:"}


def test_keys_meet_by_the_whole_of_the_shorter_one(spark):
    names = [("Process", f"supplier{n:04d}") for n in range(50)] + [("Process", "supplier0007 two"), ("Team", "supplier0007 two"), ("Process", "x"), ("Process", "box x")]
    keys = spark.createDataFrame([(label, n.replace(" ", "_"), len(n), "_".join(sorted(n.split()))) for label, n in names], "label string, key string, size int, words string")
    held = display._held(keys)
    assert {(r.label, r.key, r.by.key) for r in held.collect()} == {("Process", "supplier0007_two", "supplier0007"), ("Process", "box_x", "x")}


def test_all_neighbours_are_listed(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}", "L", f"{i:03d}") for i in range(150)], "id string, label string, name string")
    edges = spark.createDataFrame([("n000", f"n{i:03d}", "T") for i in range(1, 150)], "src string, dst string, type string")
    assert [r.id for r in graph.neighbours(nodes, edges, "n000", limit=None).collect()] == [f"n{i:03d}" for i in range(1, 150)]
