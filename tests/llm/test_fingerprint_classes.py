"""Classes of alike fingerprints against brute force over all pairs."""

import random

import pytest
from test_phrases_filters_suffixes import table

from factweave.llm import spotsigs


def texts():
    draw = random.Random(3)
    base = [f"the w{i} x{i}" for i in range(20)]
    near = [[*base[: -draw.randint(1, 4)], f"the y{draw.randrange(3)}"] for _ in range(25)] + [[f"Rome {i}", *base] for i in range(3)]
    chain = [[f"the c{j} d{j}" for j in range(i, i + 12)] for i in range(0, 9)]  # neighbours are alike, the ends are not
    other = [[f"the q{draw.randrange(40)} r{draw.randrange(40)}" for _ in range(draw.randint(1, 14))] for _ in range(30)]
    made = [("; " if i % 2 else " ").join(x) for i, x in enumerate(near + chain + other)]
    return [*made, *made[:5], None, "", "  ", "plain words", "plain words", "the " * 3000]


@pytest.mark.parametrize(("block", "turns"), [(3, 1), (1000, 2)])
def test_classes(spark, block, turns):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(None, texts()[0], "en"), (2, texts()[3], "en")]
    docs = table(spark, rows)
    got = spotsigs.fingerprint_classes(docs, block=block, turns=turns).collect()
    sets = [(r.doc_id, frozenset(r.s)) for r in docs.where("doc_id IS NOT NULL").select("doc_id", spotsigs.signatures(spotsigs.F.coalesce("text", spotsigs.F.lit(""))).alias("s")).collect()]
    first = {s: min(i for i, t in sets if t == s) for _, s in sets}
    parent = {s: s for s in first}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = 0
    for x in first:
        for y in first:
            if x != y and x and y and 10 * len(x & y) >= 8 * len(x | y):
                links += 1
                parent[root(x)] = root(y)
    least = {}
    for s in first:
        least[root(s)] = min(least.get(root(s), first[s]), first[s])
    assert sorted((r.doc_id, r.representative, r.component_id) for r in got) == sorted((i, first[s], least[root(s)]) for i, s in sets)
    assert links > 40 and len(least) > 20


def test_classes_empty(spark):
    assert spotsigs.fingerprint_classes(table(spark, [])).count() == 0
    alone = spotsigs.fingerprint_classes(table(spark, [(5, None, None), (4, "", "en"), (6, "a word", "en")])).collect()
    assert sorted(tuple(r) for r in alone) == [(4, 4, 4), (5, 4, 4), (6, 6, 6)]
