"""Searches with many query vectors, against brute force."""

from factweave.operators import retrieval


def test_vector_search(spark):
    vectors = [(i, [float((i * 7) % 5 - 2), float(i % 3), 0.5]) for i in range(40)] + [(40, None), (41, [1.0, None, 1.0]), (42, [1.0, 2.0]), (43, [])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    asked = table.where("vec_id % 10 = 0 OR vec_id > 39")
    want = set()
    for q, a in vectors:
        if (q % 10 and q < 40) or a is None or None in a:
            continue
        norm = lambda v: sum(x * x for x in v) ** 0.5
        scores = [(-round(sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)), 12) if a and b else 0.0, i) for i, b in vectors if b is not None and None not in b and len(b) == len(a)]
        want |= {(q, i, round(-s, 6)) for s, i in sorted(scores)[:6]}
    for block in (4, 1024):
        got = retrieval.vector_search(table, asked, 6, block=block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert retrieval.vector_search(table.limit(0), asked, 6).count() == 0


def test_topk_is_cosine(spark):
    table = spark.createDataFrame([(0, [10.0, 10.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in retrieval.vector_topk(table, [1.0, 0.0], 3).collect()] == [(1, 1.0), (0, 0.707107), (2, 0.0)]
    assert [r.vec_id for r in retrieval.vector_topk(table, [1.0, 0.0], 3, scope=spark.createDataFrame([(0,)], "id long")).collect()] == [0]
