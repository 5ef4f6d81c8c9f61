from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import ingest, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_keys_and_urls(spark):
    assert one(spark, T.canonical_key(F.lit("Sulfuric-Acid"))) == "sulfuric_acid"
    assert one(spark, T.canonical_key(F.lit("Foo Bar"))) == "foo_bar"
    assert one(spark, T.canonical_url(F.lit("HTTP://Site.org/a/?utm_source=x&b=2&a=1#t"))) == "http://site.org/a?a=1&b=2"
    assert one(spark, T.hash_text(F.lit("  A  b "))) == "a b"


def test_language_terms_and_pages(spark):
    assert [one(spark, T.letter_language(F.lit(x))) for x in ("медь", "медь copper", "copper")] == ["ru", "mixed", "en"]
    assert one(spark, T.prefix_stems(F.lit("обогащение"))) == ["обог", "обога", "обогащ"]
    assert one(spark, T.page_references(F.lit("see page 228 and стр. 5"))) == [228, 5]
    assert one(spark, T.significant_terms(F.lit("The leaching of the copper ore, copper"))) == ["leaching", "copper", "ore"]


def test_values(spark):
    assert tuple(one(spark, T.value_range(F.lit("1600-1700")))) == (1600.0, 1700.0)
    assert tuple(one(spark, T.value_range(F.lit("<5")))) == (None, None)
    assert one(spark, T.first_number(F.lit("12,5 MPa"))) == 12.5
    assert round(one(spark, T.celsius(F.lit(300.0), F.lit("K"))), 2) == 26.85
    assert one(spark, T.celsius(F.lit(212.0), F.lit("°F"))) == 100.0
    assert one(spark, T.citation_coverage(F.lit("A [1]. B."), F.lit(1))) == 0.5


def test_fusion_and_diversity(spark):
    ranks = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "id string, rank int")
    got = {r.id: r.score for r in retrieval.fuse(ranks).collect()}
    assert got == {"a": round(1 / 61, 9), "b": round(1 / 62 + 1 / 61, 9)}
    rows = spark.createDataFrame([("1", "x", 4.0), ("2", "x", 3.0), ("3", "x", 2.0), ("4", "y", 1.0)], "chunk_id string, doc_id string, score double")
    assert [r.doc_id for r in retrieval.diversify(rows, 2, 4).collect()] == ["x", "x", "y", "x"]


def test_packing(spark):
    rows = spark.createDataFrame([(f"c{i}", 1, i, "x" * n) for i, n in enumerate([700, 690, 20, 1500, 5])], "chunk_id string, doc_id long, chunk_index int, text string")
    got = [(r.pack, r.n_chunks, len(r.text)) for r in ingest.pack(rows).orderBy("pack").collect()]
    assert got == [(0, 2, 1392), (1, 1, 20), (2, 1, 1500), (3, 1, 5)]
    assert ingest.pack(rows, bypass=5).count() == 5 and {r.first_chunk for r in ingest.pack(rows).collect()} == {"c0", "c2", "c3", "c4"}


def test_packing_against_a_loop(spark):
    import random

    draw = random.Random(4)
    rows = [(f"{d}:{i}", d, i, "y" * draw.randint(1, 900)) for d in range(6) for i in range(draw.randint(1, 60))]
    want = {}
    for _, d, i, t in rows:
        packs = want.setdefault(d, [])
        if packs and len("\n\n".join(packs[-1])) + 2 + len(t) <= 1400:
            packs[-1].append(t)
        else:
            packs.append([t])
    got = ingest.pack(spark.createDataFrame(rows, "chunk_id string, doc_id long, chunk_index int, text string").repartition(3)).orderBy("doc_id", "pack").collect()
    assert [(r.doc_id, r.text) for r in got] == [(d, "\n\n".join(p)) for d, packs in want.items() for p in packs]
