"""Operators against brute force, and odd inputs: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import re

import public_tokenizers as P
import pytest

from factweave.llm import bpe, chat_format, components, decontaminate, importance, language_id, line_dedup, ngram_jaccard, spotsigs, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, n_tokens long, sig long"
A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [None, "", "   ", "x", A, A, A.upper(), A + " sixteen", f"{A}\nshort\n{A}", LONG, LONG + " end", "é" * 40_000, "x" * 50_000, "<|endoftext|> a b \n\n c", "12 34 !!", "Ça va où?"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", "fr", None][i % 3], i, i) for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = rows(token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), piece_chars=1000))
    for i, t in enumerate(TEXTS):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024)
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0
    assert token_counts.token_counts(docs.union(docs), P.path("byte_bpe_50k.json")).count() == 2 * len(TEXTS)


def test_bpe(docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(bpe.bpe_codec(docs, path, P.PATTERN, chunk_chars=700, overlap_chars=50, keep_ids=True))
    for i, t in enumerate(TEXTS):
        assert got[i].ids == whole.encode_ordinary(t or "")
        assert bytes(got[i].decoded).decode() == (t or "")
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_codec(none, path, P.PATTERN).count() == 0


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontaminate(spark, docs, none):
    items = [(0, A), (1, "one two"), (2, None), (3, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"), (4, "not there at all"), (5, A), (6, "où")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.decontaminate(docs, table))
    for i, t in enumerate(TEXTS):
        words, hit, found = brute_words(t), set(), set()
        for item, text in items:
            own = brute_words(text)
            w = min(10, len(own))
            for j in range(len(own) - w + 1 if own else 0):
                for p in range(len(words) - w + 1):
                    if words[p] == own[j] and words[p : p + w] == own[j : j + w]:
                        hit |= set(range(p, p + w))
                        found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].contaminated) == (len(words), len(hit), sorted(found), bool(hit)), i
    assert decontaminate.decontaminate(none, table).count() == 0
    assert decontaminate.decontaminate(docs, table.limit(0)).where("contaminated").count() == 0


def test_importance(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (9, 0, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    got = importance.importance_resample(docs, labels, fraction=0.5).collect()
    assert sum(r.selected for r in got) == 8
    kept, gone = [r.sample_key for r in got if r.selected], [r.sample_key for r in got if not r.selected]
    assert min(kept) >= max(gone)
    assert {r.doc_id: r.log_weight for r in got}[0] == 0
    assert importance.importance_resample(none, labels).count() == 0
    assert not any(r.selected for r in importance.importance_resample(docs, labels.limit(0)).collect())


def test_url_filter(spark):
    pages = spark.createDataFrame(
        [(0, "http://a.net/x", ""), (1, "https://www.b.com/y?ref=1", '<link rel="canonical" href="http://c.com/z">'), (2, "http://c.com/z#f", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'), (3, None, None), (4, "nothing", ""), (5, "http://Q.Example.NET/en/1", ""), (6, "http://d.com/", "")],
        "page_id long, url string, html string",
    )
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1][2:] == got[2][2:] == (None, "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("q.example.net", "/en/1", "example.net/en/", "allow")
    assert got[6][3] == "allow"
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0


def test_url_filter_sources_that_are_no_pages(spark):
    pages = spark.createDataFrame([(0, "http://one.com/x", ""), (1, "http://two.com/x", ""), (2, "http://three.com/x", ""), (3, "http://four.com/x", "")], "page_id long, url string, html string")
    moves = [("http://old.net/a", "http://one.com/x"), ("http://www.example.net/en/b", "http://two.com/x"), ("http://bad.net/b", "http://two.com/x"), ("http://far.net/c", "http://middle.com/c"), ("http://middle.com/c", "/d"), ("http://middle.com/d", "http://three.com/x"), (None, "http://four.com/x")]
    redirects = spark.createDataFrame(moves, "source string, target string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rule_table(spark, url_filter.RULES), redirects=redirects).collect()}
    assert got == {0: (None, "block"), 1: (None, "allow"), 2: (None, "block"), 3: (None, "allow")}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(edges.limit(0)).count() == 0


def word_edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True))
    a, b = sorted((a, b), key=len)
    return 1 if any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 2


def test_line_dedup(spark, docs, none):
    base = "a b c d e f g h"
    extra = ["A b c d e f g h", "a b X d e f g h", "a b d e f g h", "a b c d e f g h i", "b c d e f g h i", "a a b c d e f g h", "p q r", "p q r", "the the the the the", "the the the the"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100, base)] + [(101 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    source = sorted((r.doc_id, r.text or "") for r in table.collect())
    seen, want = [], {}
    for i, text in source:
        out = []
        for line in text.split("\n"):
            words = [w for w in line.lower().split(" ") if w]
            gone = words and any(words == s or min(len(words), len(s)) >= 5 and word_edits(words, s) <= 1 for s in seen)
            seen.append(words)
            if not gone:
                out.append(line)
        want[i] = "\n".join(out)
    got = rows(line_dedup.line_dedup(table))
    assert {i: got[i].text for i in want} == want
    assert line_dedup.line_dedup(none).count() == 0


def jaccard_classes(source):
    sets = {}
    for i, t in source:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_jaccard(spark, docs, none):
    import random

    draw = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    near = []
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = f"z{draw.randrange(50)}"
        near.append((200 + i, " ".join(copy)))
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    want = jaccard_classes([(r.doc_id, r.text) for r in table.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(table).collect()}
    assert got == want
    assert ngram_jaccard.ngram_jaccard(none).count() == 0


def test_spotsigs(spark, docs, none):
    got = rows(spotsigs.fingerprints(docs))
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        q, following = len(t) // 4, texts[(i + 1) % len(texts)]
        assert got[i].edited == t[: len(t) - q] + following[:q]
        assert got[i].n_chars == len(t)
        a, b = set(got[i].fingerprint), set(got[(i + 1) % len(texts)].fingerprint)
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[4].fingerprint == got[5].fingerprint
    text = "The cat sat on the mat, and the dog of Rome ran."
    spots = {"the cat sat", "the mat", "the dog", "of rome ran"}
    made = spark.createDataFrame([(text,)], "t string").select(spotsigs.F.transform(spotsigs._spots(spotsigs.F.col("t"), 3), lambda x: x).alias("s")).first().s
    assert set(made) == spots
    assert spotsigs.fingerprints(none).count() == 0
    lone = spotsigs.fingerprints(docs.where("doc_id = 4")).first()
    assert lone.near_next == 1.0
    pairs = {(r.a, r.b) for r in spotsigs.similar_pairs(docs, threshold=0.9).collect()}
    assert all(a < b for a, b in pairs)


def test_spotsigs_links(spark, docs, none):
    """Membership and pairs against brute force, where different texts have one fingerprint, and with lists cut into blocks."""
    import random

    draw = random.Random(3)
    base = [f"the w{i} x{i}" for i in range(20)]
    near = [[*base[: -draw.randint(1, 4)], f"the y{draw.randrange(3)}"] for _ in range(25)] + [[f"Rome {i}", *base] for i in range(3)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, ("; " if i % 2 else " ").join(x)) for i, x in enumerate(near)] + [(None, " ".join(base))], "doc_id long, text string"))
    sets = {r.doc_id: frozenset(r.fingerprint) for r in spotsigs.fingerprints(table).collect()}
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    want = {("equal", first[s], i): 1.0 for i, s in sets.items()}
    for a, b in itertools.combinations(sorted(first.values()), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            want["alike", a, b] = len(x & y) / len(x | y)
    assert sum(k == "equal" and a != b for k, a, b in want) > 3 and sum(k == "alike" for k, *_ in want) > 10
    for block in (3, 1000):
        got = spotsigs.fingerprint_links(table, block=block).collect()
        assert len(got) == len(want)
        assert {(r.kind, r.a, r.b): r.likeness for r in got} == pytest.approx(want)
    assert spotsigs.fingerprint_links(none).count() == 0


def test_chat_format(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s> [\\INST]", None, "\\", "[TURN x] a [/TURN] </s></s>"]
    turns = [(1, i, r, t) for i, (t, r) in enumerate(itertools.product(texts, ["user", "assistant", "system", "to ol]", None]))]
    table = spark.createDataFrame(turns + [(2, 0, "user", "x"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    made = chat_format.chat_format(chat_format.table_events(table)).withColumn("turns", chat_format.read_back(chat_format.F.col("formatted")))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.collect()}
    assert got[1] == [(r or "", t or "") for _, _, r, t in turns]
    assert got[2] == [("user", "x")] * 2
    log = [(1, 0, 0, "delta", "a", "he"), (1, 0, 1, "regenerate", "a", None), (1, 0, 2, "delta", "a", "x"), (1, 0, 3, "edit", "a", "y"), (1, 0, 4, None, "a", "z"), (1, 1, 0, "delta", "b", "gone"), (1, 1, 1, "delete", "b", None)]
    events = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, payload string")
    assert [(r.role, r.text) for r in chat_format.fold(events).collect()] == [("a", "yz")]
    assert chat_format.chat_format(events.limit(0)).count() == 0


def test_language_id(spark, docs, none):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(table.where(~language_id.held_out()))
    judged = language_id.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").where(language_id.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in judged)
    got = rows(language_id.predict(docs, model))
    assert [got[i].lang_pred for i in (0, 1, 2, 14)] == ["und"] * 4
    assert language_id.predict(none, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(none)).collect()} == {"und"}
