"""Models, fingerprints, boundaries and the whole pipeline against plain loops, and odd inputs of every operator."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import A, LONG, brute_words, jaccard_classes, word_edits

import corpus_pipeline
from factweave.llm import bpe, bytesets, chat_format, decontaminate, importance, language_id, line_dedup, ngram_jaccard, spotsigs, token_counts, url_filter

FOLDER = "/root/testdata/sf0.001"


def word_hash(word: bytes):
    return bytesets.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), bytesets.NONSPACE)[2][0]


def buckets(text):
    """Buckets of words and word pairs, one by one."""
    hashes = [word_hash(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    of = lambda x: int(x) >> 50
    return [of(bytesets.mix(np.array([h]))[0]) for h in hashes] + [of(bytesets.grams(np.array([a, b]), 2)[0]) for a, b in zip(hashes, hashes[1:], strict=False)]


def test_importance_weights_and_choice(spark):
    texts = {0: "a good text of good words", 1: "a good word", 2: None, 3: "", 4: "bad stuff bad Stuff", 5: "good text", 6: "  ", 7: "words of a text", 8: LONG}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 1, 0), (4, 0, 1), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    raw, good = Counter(), Counter()
    for i, t in texts.items():
        raw.update(buckets(t))
        if i in (0, 1):
            good.update(buckets(t))
    n = importance.BUCKETS
    ratio = lambda b: math.log((good[b] + 1) / (good.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))
    noise = {r.doc_id: (r.u % (1 << 52) + 0.5) / float(1 << 52) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("u")).collect()}
    got = {r.doc_id: r for r in importance.importance_resample(docs, labels, fraction=4 / 9).collect()}
    keys = {}
    for i, t in texts.items():
        b = buckets(t)
        assert got[i].n_grams == len(b) and got[i].log_weight == pytest.approx(sum(map(ratio, b)))
        keys[i] = sum(map(ratio, b)) - math.log(-math.log(noise[i]))
        assert got[i].sample_key == pytest.approx(keys[i])
    assert {i for i in texts if got[i].selected} == set(sorted(keys, key=lambda i: (-keys[i], i))[:4])
    bare = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " \n", None])], "doc_id long, text string").coalesce(1)
    assert [(r.n_grams, r.log_weight) for r in importance.importance_resample(bare, labels).collect()] == [(0, 0.0)] * 4
    again = importance.importance_resample(docs.union(docs).union(docs), labels, fraction=1 / 9).collect()
    assert all(len({r.selected for r in again if r.doc_id == i}) == 1 for i in texts) and sum(r.selected for r in again) == 3


def plain_mixture(logs, turns=6, penalty=2.0):
    """Expectation-maximisation of one document, in loops."""
    n, k = len(logs), len(logs[0])
    like = [[math.exp(max(x - max(row), -60)) for x in row] for row in logs]

    def fit(share, turns):
        for _ in range(turns):
            new = [0.0] * k
            for row in like:
                total = sum(x * s for x, s in zip(row, share, strict=True)) + 1e-30
                for j in range(k):
                    new[j] += row[j] * share[j] / total
            share = [x / n for x in new]
        return share, sum(math.log(sum(x * s for x, s in zip(row, share, strict=True)) + 1e-30) for row in like)

    full, _ = fit([1 / k] * k, turns)
    order = sorted(range(k), key=lambda j: -full[j])
    best, chosen = -math.inf, None
    for size in range(1, k + 1):
        share, value = fit([1 / size if j in order[:size] else 0.0 for j in range(k)], turns if size > 1 else 1)
        value -= penalty * (size - 1) * math.log(n + 1)
        if value <= best:
            break
        best, chosen = value, share
    return full, chosen


def test_language_mixtures():
    draw = random.Random(2)
    docs = []
    for parts in ([40, 0, 0, 0, 0], [30, 30, 0, 0, 0], [20, 25, 30, 28, 0], [3, 0, 0, 0, 1], [12, 0, 9, 0, 0], [1, 0, 0, 0, 0]):
        docs.append([[draw.gauss(0, 1) + (9 if j == lang else 0) for j in range(5)] for lang, n in enumerate(parts) for _ in range(n)])
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    share, chosen = language_id.infer(np.array([row for d in docs for row in d], np.float32), first)
    for i, d in enumerate(docs):
        full, best = plain_mixture(d)
        assert share[i] == pytest.approx(full, abs=2e-3) and chosen[i] == pytest.approx(best, abs=2e-3)
    assert (chosen > 0).sum(axis=1).tolist()[:3] == [1, 2, 4]


def test_language_counts(spark):
    """The log-probabilities of words and trigrams against counts by hand."""
    table = spark.createDataFrame([("aa ab", "x"), ("ab", "y"), (None, "x"), ("zz", None)], "text string, lang string")
    names, logs = language_id.train(table)
    assert names == ["x", "y"]
    words = logs[language_id.BUCKETS :]
    smooth = lambda n, total: math.log((n + 0.5) / (total + 0.5 * language_id.BUCKETS))
    assert sorted(words[:, 0])[-2:] == pytest.approx([smooth(1, 2)] * 2, abs=1e-4) and max(words[:, 1]) == pytest.approx(smooth(1, 1), abs=1e-4)
    assert max(logs[: language_id.BUCKETS, 1]) == pytest.approx(smooth(1, 2), abs=1e-4)


def plain_spots(text, chain=3):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return {" ".join(s) for s in spots_of(words, chain)} or ({" ".join(words)} if words else set())


def spots_of(words, chain):
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            tail = []
            for x in words[i + 1 : i + 1 + chain]:
                if x in spotsigs.ANCHORS:
                    break
                tail.append(x)
            if tail:
                yield (w, *tail)


def test_spotsigs_fingerprints(spark):
    texts = ["The cat sat on the mat of Rome.", "the cat; the dog and the end", "No anchor-free words", "", None, "Der Hund ist groß und die Katze klein, sehr klein und fein", "the the the", "x " * 30 + "the end of all days here", A]
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    plain = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + plain[(i + 1) % len(plain)][: len(t) // 4] for i, t in enumerate(plain)]
    spots = {s: None for t in plain + edited for s in plain_spots(t)}
    hashes = {r.s: r.h for r in spark.createDataFrame([(s,) for s in spots], "s string").select("s", F.hash("s").alias("h")).collect()}
    sets = lambda t: {hashes[s] for s in plain_spots(t)}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    for i, t in enumerate(plain):
        r = got[f"k{i}"]
        assert r.edited == edited[i] and set(r.fingerprint) == sets(t) and set(r.edited_fingerprint) == sets(edited[i])
        assert r.near_edited == pytest.approx(like(sets(t), sets(edited[i]))) and r.near_next == pytest.approx(like(sets(t), sets(plain[(i + 1) % len(plain)])))
    pairs = {(r.a, r.b) for r in spotsigs.similar_pairs(docs.union(docs.limit(0)), threshold=0.2).collect()}
    firsts = {frozenset(sets(t)): f"k{i}" for i, t in reversed(list(enumerate(plain)))}
    want = {(min(x, y), max(x, y)) for a, x in firsts.items() for b, y in firsts.items() if x < y and a and b and like(set(a), set(b)) >= 0.2}
    assert pairs == want


def test_pieces_of_texts_without_blanks():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for text in ("日本語、テキスト。" * 400, "ab12cd'se34" * 500, "a<|endoftext|>1" * 300, "x" * 3000, "é1é" * 900, "don't1can't" * 300):
        pieces = token_counts.safe_pieces(text, 100, ("<|endoftext|>",))
        assert "".join(pieces) == text and sum(map(count, pieces)) == count(text)
        assert len(pieces) > 5 or text[0] == "x"


def test_long_texts_in_chunks(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [LONG, "y" * 5000 + " and then " * 300 + "z" * 900 + " end", "ab " * 2000 + "q" * 3000, "é " * 1000, LONG, None]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)] + [(None, LONG)], "doc_id long, text string")
    got = sorted(bpe.bpe_codec(docs, path, P.PATTERN, chunk_chars=800, overlap_chars=100, keep_ids=True).collect(), key=str)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted((str(d), whole.encode_ordinary(t or ""), (t or "").encode()) for d, t in [(i % 5, t) for i, t in enumerate(texts)] + [(None, LONG)])
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)


def test_url_methods(spark):
    """Decisions spread over chains, cycles and alias keys, against a walk."""
    draw = random.Random(8)
    urls = [f"http://h{draw.randrange(12)}.{draw.choice(['net', 'com', 'org', 'example.net'])}/{draw.choice(['en/', 'fr/', ''])}{draw.randrange(6)}{draw.choice(['', '/', '.html', '?ref=1'])}" for _ in range(120)] + [None, "bare", ""]
    moves = [(draw.choice(urls), draw.choice(urls)) for _ in range(40)]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "") for i, u in enumerate(urls)] * 2, "page_id long, url string, html string")
    table = spark.createDataFrame(moves, "source string, target string")
    cells = {r.url: r for r in pages.select("url").union(table.select("source")).union(table.select("target")).distinct().select("url", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"), url_filter.alias_key(F.col("url")).alias("alias")).collect()}

    def ruled(u):
        fit = [(len(r), r, v) for r, v in url_filter.RULES if u and (cells[u].host == r.split("/")[0] or cells[u].host.endswith("." + r.split("/")[0])) and cells[u].path.startswith("/" + r.split("/", 1)[1])]
        return max(fit)[1:] if fit else (None, None)

    links = [(u, "alias " + c.alias) for u, c in cells.items() if u is not None and c.alias is not None]
    for s, t in moves:
        full = t if t and "://" in t else None  # a target without :// is seen from its source, and none of these paths is a page
        if s and full:
            links.append((s, full))
        elif s and t and "://" in s:
            own = cells[s]
            links.append((s, f"{s.split('://')[0]}://{own.host}{re.sub('[^/]*$', '', own.path) or '/'}{t}"))
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def verdict(u):
        rule, v = ruled(u)
        if v or u not in near:
            return rule, v or "allow"
        seen, todo = {u}, [u]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        said = {ruled(x)[1] for x in seen if x in cells}
        return rule, "block" if "block" in said and "allow" not in said else "allow"

    got = Counter((r.page_id, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rule_table(spark, url_filter.RULES), redirects=table).collect())
    assert got == Counter((i if i % 9 else None, *verdict(u)) for i, u in enumerate(urls) for _ in range(2))


NAMES = ["id", "key", "h1", "h2", "slot", "alias", "kept_text", "n", "sig", "row", "batch", "salt", "wanted", "pos", "range", "words"]


def test_odd_inputs(spark, tmp_path):
    """Null and repeated ids, repeated rows, ties, and columns with the names that operators use inside."""
    texts = [(1, A), (1, A), (2, None), (None, A), (None, "no id here but words"), (None, None), (3, ""), (4, LONG), (1, "another text under a known id, twice known"), (5, A)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string").select("*", *(F.lit("x").alias(n) for n in NAMES)).repartition(3)
    model = language_id.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, A), (1, A), (1, A)], "item_id long, text string")
    path = P.path("byte_bpe_50k.tiktoken")
    for made in (
        token_counts.token_counts(docs, P.path("byte_bpe_50k.json")), bpe.bpe_codec(docs, path, P.PATTERN), language_id.predict(docs, model, keep=tuple(docs.columns)), importance.importance_resample(docs, labels),
        line_dedup.line_dedup(docs, keep=tuple(NAMES)), ngram_jaccard.ngram_jaccard(docs),
    ):
        assert sorted(str(r.doc_id) for r in made.collect()) == sorted(str(i) for i, _ in texts)
    hit = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(hit) == {1, 2, 3, 4, 5, None} and [hit[i].contaminated for i in (1, 2, 3, 4, 5, None)] == [True, False, False, False, True, True] and hit[5]["items"] == ["1"]
    assert sorted(r.doc_id for r in spotsigs.fingerprints(docs).collect()) == [1, 1, 1, 2, 3, 4, 5]
    kept = line_dedup.line_dedup(docs, keep=("text", "id")).where("doc_id IS NULL").collect()
    assert sorted(str(r.text) for r in kept) == sorted([A, "no id here but words", ""]) and {r.kept_text for r in kept} == {A, "no id here but words", None}
    classes = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard(docs).where("n_shingles > 5").collect()}
    assert classes[5] == 1 and classes[4] == 4
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, "assistant", None), (1, 2, None, "b" * 50_000)], "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1))
    made = {r.conv_id: r.t for r in chat_format.chat_format(chat_format.table_events(turns)).select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    assert [tuple(x) for x in made[None]] == [("user", "a")] * 2 and [tuple(x) for x in made[1]] == [("assistant", ""), ("", "b" * 50_000)]
    spark.createDataFrame([(0, "not in any text of them at all, in no way whatever")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    part = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *NAMES)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, part, str(tmp_path))
        assert out.columns == part.columns and 0 < out.count() <= len(texts)
        assert stage(spark, part.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, part, str(tmp_path)).count() == len(texts)


def test_pipeline_against_loops(spark, tmp_path):
    """run() on a small folder against plain loops; what the language model keeps is taken from its own predictions."""
    import tiktoken

    base = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"
    extra = [(500, base[0][1], "de"), (501, f"{base[1][1]} {item}", "en"), (502, "12 34", "en"), (503, None, "en"), (504, base[2][1] + " one more", "fr"), (505, "all new words are these\nall new words are those", "en"), (506, base[3][1].split("\n")[0] + "\na line of this document alone, it is", "en")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in base + extra]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    kept = {r.doc_id for r in language_id.predict(docs, model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert 502 not in kept and 503 not in kept and len(kept) > 50

    seen, lines = [], {}
    for i, t, *_ in sorted(r for r in rows if r[0] in kept):
        out = []
        for line in t.split("\n"):
            words = [w for w in line.lower().split(" ") if w]
            gone = words and any(words == s or min(len(words), len(s)) >= 5 and abs(len(words) - len(s)) <= 1 and word_edits(words, s) <= 1 for s in seen)
            seen.append(words)
            if not gone:
                out.append(line)
        if len(out) == len(t.split("\n")) or "\n".join(out).strip(" "):
            lines[i] = "\n".join(out)
    classes = jaccard_classes(sorted(lines.items()))
    single = {i: t for i, t in lines.items() if classes[i][1] == i}
    window = brute_words(item)
    clean = {i: t for i, t in single.items() if not any(brute_words(t)[p : p + 10] == window[j : j + 10] for j in range(3) for p in range(len(brute_words(t))))}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(ids := whole.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, t in clean.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 501 not in got and 500 not in got
