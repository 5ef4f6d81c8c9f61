"""Operators 11 to 13 against loops, and their odd inputs: nulls, empty and long texts, repeated rows and ids, empty tables, clashing columns."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from factweave.llm import collocations, filter_audit, suffix_dedup

#: Columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, key long, n long, part string, text_2 string, gram long, k long, hot boolean"


def table(spark, rows, n=3):
    return spark.createDataFrame([(*r, 5, 6, "p", "t", 7, 8, True) for r in rows], SCHEMA).repartition(n)


# Collocations ------------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, longest, best):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    f = {x: a for x, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, i + 1, p.decode(), -a, left, right, total, -s) for lang, xs in out.items() for i, (s, a, p, left, right, total) in enumerate(sorted(xs)[:best])}


def phrase_rows(seed=3):
    draw = random.Random(seed)
    vocabulary = ["The", "new", "big", "yorK", "stadt", "Éa", "ça", "x y", "a\x00b", "-"]
    rows = [(i, " ".join(draw.choice(vocabulary) + draw.choice(["", "", "", ".", "\n", "\t", "; ", "!"]) for _ in range(draw.randint(0, 60))), draw.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(i, "new york city hall stands, new york", "en") for i in range(100, 112)] * 2
    return [*rows, (None, None, "en"), (1, "", None), (1, "   ", "fr"), (7, "one two " * 3000, "long"), (8, "the\tNEW\tbig", None)]


@pytest.mark.parametrize(("least", "shards", "best"), [(6, 4, 2000), (6, 1, 5), (3, 9, 2000)])
def test_collocations(spark, least, shards, best):
    rows = phrase_rows()
    got = collocations.collocations(table(spark, rows), min_count=least, shards=shards, best=best).collect()
    want = plain_collocations(rows, least, 5, best)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 8


def test_collocations_empty(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None), (2, " . ", "en")]), min_count=1).count() == 0


def test_scores_pass_64_bits(spark):
    """Products of counts near 10^11 are exact."""
    a, n, left, right = 10**11, 10**13 + 7, 3 * 10**11, 10**11 + 3
    counts = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, left), ("en", "b", 1, right)], "lang string, phrase string, k int, n long")
    from pyspark.sql import functions as F

    totals = counts.select(F.xxhash64("lang").alias("lang_key"), F.lit(n).alias("total")).distinct()
    r = collocations.scored(counts, totals, best=10).first()
    assert r.score == 1000 * a * n // (left * right) and (r.a, r.l, r.r, r.n) == (a, left, right, n)


# Filters -----------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[j] == 1} for j in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    judged = []
    for i, t, part in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        judged.append((part or "", {c for c, x in fails.items() if x}, i in good, i in toxic))
    out, total = {}, Counter()
    for part in {p for p, *_ in judged}:
        for order in permutations("ABCDE"):
            left = [x for x in judged if x[0] == part]
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                own = [x for x in judged if x[0] == part and c in x[1]]
                total[part, c] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(own) - len(gone), sum(x[1] == {c} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {(*at, *x, total[at[0], at[1][at[2] - 1]]) for at, x in out.items()}


def test_filter_audit(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(draw.sample(words, draw.choice([20, 120]))) + draw.choice(["", "", " #", " $"]) + draw.choice(["", "X" * 80]) for _ in range(40)] + [" ".join(["same word"] * 120), "É" * 50, None, ""]
    rows = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(3, "long " * 50_000, "long"), (1, None, "nul")] + rows[:10]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 4, 6, None]]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(table(spark, rows), marks).collect()
    assert {tuple(r) for r in got} == plain_audit(rows, labels) and len(got) % 600 == 0
    assert filter_audit.filter_audit(table(spark, []), marks).count() == 0
    bare = filter_audit.filter_audit(table(spark, rows), marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(bare) == (0, 0)


def test_potentials_are_shapley_values(spark):
    """For any game: the potential of all less that without a filter is the average of its steps."""
    draw = random.Random(9)
    worth = [0] + [draw.randint(0, 10**12) for _ in range(15)]
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(worth,)], "v array<long>").select(filter_audit.potentials(F.col("v"), 4).alias("p")).first().p
    for i in range(4):
        steps = 0
        for order in permutations(range(4)):
            before = sum(1 << j for j in order[: order.index(i)])
            steps += worth[before | 1 << i] - worth[before]
        assert p[15] - p[15 - (1 << i)] == steps


# Suffixes ----------------------------------------------------------------------------------------


def plain_dedup(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), bytes(b for b, g in zip(d, gone[:-1], strict=True) if not g)))
    return out


def suffix_texts(seed, length):
    """Random texts with passages of about ``length`` bytes in many contexts, near copies, periodic texts and multibyte characters."""
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice("abé\0 xyzàö") for _ in range(n))
    passages = [word(draw.randint(length // 2, 2 * length)) for _ in range(6)]
    passages += [p[: len(p) // 2] + word(3) + p[len(p) // 2 :] for p in passages] + [p[1:-1] for p in passages]
    texts = [word(draw.randint(0, 2 * length)) + draw.choice(passages) + word(draw.randint(0, length)) + draw.choice(passages) for _ in range(60)]
    base = word(6 * length)
    texts += [base, base, base[:-1] + "!", base[: 3 * length] + "?" + base[3 * length :], base[1:]]
    return [*texts, "a" * 5 * length, "ab" * 4 * length, "a" * length, "a" * (length - 1), None, "", None, base[:length], base[: length - 1]]


@pytest.mark.parametrize(("seed", "length", "most"), [(1, 24, 1 << 15), (2, 24, 3), (3, 7, 1 << 15), (4, 60, 1 << 15), (5, 60, 2), (6, 2, 1 << 15), (7, 1, 4)])
def test_suffix_dedup(spark, seed, length, most):
    texts = suffix_texts(seed, length)
    docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, length=length, most_group=most).collect()}
    want = plain_dedup(texts, length)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 0


def test_suffix_dedup_odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    rows = [(1, "once " * 100, None), (1, "once " * 100, None), (None, "twice or not " * 40, "en"), (None, "another null id" * 40, "en"), (5, long, "en"), (6, "abc", "en")]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect())
    assert got == sorted(plain_dedup([t for _, t, _ in rows], 400))
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0
    assert [r.n_removed for r in suffix_dedup.suffix_dedup(table(spark, [(1, None, None)])).collect()] == [0]


@pytest.mark.parametrize("most", [1 << 15, 40])
def test_suffix_dedup_frequent(spark, monkeypatch, most):
    """A passage in many surroundings: the rows of its key, or of its strings, are split over tasks by Spark's skew handling."""
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrst") for _ in range(n))
    passage, plans, write = word(40), [], suffix_dedup.held
    texts = [word(30) + passage + word(30) for _ in range(400)]

    def spy(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return write(df)

    few = {"shuffle.partitions": "8", "autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "1k"}
    few |= {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in few}
    monkeypatch.setattr(suffix_dedup, "held", spy)
    try:
        for k, v in few.items():
            spark.conf.set(f"spark.sql.{k}", v)
        docs = table(spark, [(i, t, "en") for i, t in enumerate(texts)], 8)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, length=24, most_group=most).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    assert [got[i] for i in range(len(texts))] == plain_dedup(texts, 24)
    joins = [p for p in plans if "LeftSemi" in p]
    assert len(joins) == (1 if most > 400 else 2) and all("skew=true" in p for p in joins)


def test_suffix_order():
    """Deep-shallow sorting against sorted(), with zeros, prefixes and long common beginnings."""
    draw = random.Random(1)
    for _ in range(60):
        texts = [bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 150))) for _ in range(draw.randint(0, 30))]
        base = bytes(draw.choice(b"abcd") for _ in range(200))
        texts += [base[: draw.randint(0, 200)] + bytes(draw.choice(b"ab") for _ in range(5)) for _ in range(draw.randint(1, 30))]
        order, lcp = suffix_dedup.suffix_order(texts)
        ordered = [texts[i] for i in order]
        assert ordered == sorted(texts) and sorted(order.tolist()) == list(range(len(texts)))
        for a, b, n in zip(ordered, ordered[1:], lcp[1:], strict=False):
            assert a[:n] == b[:n] and a[: n + 1] != b[: n + 1] or a == b[: len(a)] and n == min(len(a), len(b))
