from collections import Counter

from test_operators import jaccard_classes

import corpus_pipeline


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == before == corpus_pipeline.run(spark, folder).count()


def test_rows_without_and_with_repeated_ids(spark, tmp_path):
    """Near duplicates and decontamination against brute force over rows, where ids are null or repeated."""
    base = [f"t{i}" for i in range(60)]
    near = " ".join([*base[:-1], "z"])
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
    texts = [
        (1, " ".join(base)), (2, near), (2, "only here is this said of repeated ids"), (3, "a b c d e f g"), (3, "a b c d e f g"), (3, "A b c d e f g"),
        (None, "no id and no copy at all"), (None, near + " y"), (None, "p q r s t u v w"), (None, "P q r s t u v w"), (4, ""), (None, None), (None, " ".join(f"n{i}" for i in range(50))), (None, " ".join(f"n{i}" for i in range(49))),
        (5, "head " + item), (5, "five has a clean text too"), (None, item + " tail"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    classes = {}
    for place, (_, c) in jaccard_classes([(j, t) for j, (_, t) in enumerate(texts)]).items():
        classes.setdefault(c, []).append(place)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left.total() == len(classes)
    for places in classes.values():
        first = min((texts[j][0] is None, texts[j][0] or 0) for j in places)
        ties = {texts[j] for j in places if (texts[j][0] is None, texts[j][0] or 0) == first}
        assert sum(left[t] for t in ties) == 1

    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter(t for t in texts if item not in (t[1] or ""))
