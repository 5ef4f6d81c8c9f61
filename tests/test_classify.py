import pytest
from pyspark.sql import functions as F

from factweave.functions import classify as K
from factweave.operators import thinning, upserts

KINDS = {"2019 год": "temporal", "nickel_content": "parameter", "Temperature": "parameter", "Smith & Sons": "organization", "BHP": "organization", "leaching": "process", "обогащение": "process", "yield strength": "process", "old mine": "facility", "насосы": "equipment", "big reactor": "equipment", "ore": None, "Fe2O3": None, "": None, "zz": None}


def test_kinds(spark):
    rows = spark.createDataFrame([*((n,) for n in KINDS), (None,)], "name string").select("name", K.entity_kind(F.col("name")).alias("kind"), K.foreign_script(F.col("name")).alias("cjk")).collect()
    assert {r.name: r.kind for r in rows if r.name is not None} == KINDS
    assert not any(r.cjk for r in rows)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_thin_batches(spark, k):
    texts = [("1 " * (i % 7)) for i in range(20)]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pack int, text string")
    got = sorted(r.pack for r in thinning.thin_batches(rows, k).collect())
    ranked = sorted(range(20), key=lambda i: (-min(3.0, (i % 7) / 4), i))
    must = {0, 19, *ranked[: max(2, k // 3)]}
    step = max(1, 19 // max(1, k - len(must)))
    assert got == ([10] if k == 1 else list(range(20)) if k >= 20 else sorted(must | set(range(0, 20, step)))[:k])


def test_patch_and_latest(spark):
    stored = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    change = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "id long, v string")
    assert sorted((r.id, r.v) for r in upserts.patch(stored, change, "id").collect()) == [(1, "a"), (2, "b")]
    assert sorted((r.id, str(r.v)) for r in upserts.latest(stored, change, ["id"]).collect()) == [(1, "None"), (2, "b"), (3, "c")]
