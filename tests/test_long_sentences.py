"""Sentences of a text whose end is long and has no full stop."""

from factweave.operators import retrieval


def test_long_end_without_a_stop(spark):
    texts = [("a", "No. 1 is the first. " + "word and " * 20000), ("b", "It cost 3.5 and 7. Then nothing! The 2nd, 4,5 ... 6?x 7")]
    got = {r.chunk_id: r.snippet for r in retrieval.best_sentences(spark.createDataFrame(texts, "chunk_id string, text string"), ["the", "and"]).collect()}
    assert got == {"a": "1 is the first.", "b": "It cost 3.5 and 7. The 2nd, 4,5 . 6?"}
