"""Operator 11: phrase collocation mining by SON partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesets as B
from .components import held

#: Bits of the tables that thin out phrases before they are counted; their size does not depend on the data.
BITS = 1 << 26
#: Signs at which a text falls into pieces, and all bytes that are no part of a word.
_BREAK = np.isin(np.arange(256), list(b".,;:!?") + list(range(10, 14)))
_WORD = ~(_BREAK | np.isin(np.arange(256), [9, 32]))


def _bits(slots: DataFrame) -> np.ndarray:
    """Bits of the slots (column slot) of a table of BITS: put together in Spark, 4 kB rows come to the driver."""
    at, table = F.col("slot") + 1, np.zeros(BITS // 8, np.uint8)
    for r in slots.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        own = np.frombuffer(r.bits, np.uint8)
        table[(r.bucket - 1) * len(own) :][: len(own)] = own
    return table


def _slot(group: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Where a phrase of a group stands in a table; both are hashes.  ``_slots`` is the same in Spark."""
    return ((gram ^ group) >> np.uint64(38)).astype(np.int64)


def _slots(phrases: DataFrame, group: Column) -> DataFrame:
    return phrases.select(F.shiftrightunsigned(F.col("gram").bitwiseXOR(group), 38).alias("slot"))


def _has(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _read(batch: pa.RecordBatch):
    """Words of a batch of texts: bytes, starts, ends, hashes, and the piece and the text that each belongs to."""
    raw, at = B.buffers(batch.column("text"))
    starts, ends, hashes, first = B.words(raw, at, _WORD)
    text = B.owner(first)
    breaks = np.cumsum(_BREAK[raw], dtype=np.int32)
    piece = breaks[starts] if len(starts) else np.empty(0, np.int64)
    return raw, starts, ends, hashes, piece, text


def _grams(hashes: np.ndarray, piece: np.ndarray, text: np.ndarray, k: int):
    """Places where k words stand in one piece, and their hashes."""
    keys = B.grams(hashes, k)
    n = len(keys)
    inside = (piece[:n] == piece[k - 1 : k - 1 + n]) & (text[:n] == text[k - 1 : k - 1 + n])
    places = np.flatnonzero(inside)
    return places, keys[places]


def _mine(sizes: tuple[int, ...], shared: Broadcast | None, below: int):
    """Count, by group, the phrases of the given sizes whose parts of ``below`` words are all in the table (all phrases without a table).

    Columns: lang_key, shard, gram, n.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        table = shared.value if shared else None
        for batch in B.portions(batches, "text", 1 << 22):
            *_, hashes, piece, text = _read(batch)
            group = batch.column("grp").to_numpy().view(np.uint64)[text] if len(text) else np.empty(0, np.uint64)
            if table is not None:
                parts = B.grams(hashes, below)
                known = _has(table, _slot(group[: len(parts)], parts))
            for k in sizes:
                places, keys = _grams(hashes, piece, text, k)
                if table is not None:
                    good = known[places]
                    for j in range(1, k - below + 1):
                        good &= known[places + j]
                    places, keys = places[good], keys[good]
                if len(keys):
                    new, n = _first(group[places], keys)
                    there = pa.array(text[places[new]])
                    yield pa.RecordBatch.from_arrays([batch.column("lang_key").take(there), batch.column("shard").take(there), pa.array(B.signed(keys[new])), pa.array(n)], ["lang_key", "shard", "gram", "n"])

    return run


def _first(group: np.ndarray, keys: np.ndarray):
    """One index for each pair of group and key, and how often the pair is there."""
    order = np.lexsort((keys, group))
    own, sorted_keys = group[order], keys[order]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (sorted_keys[1:] != sorted_keys[:-1])])
    return order[new], np.diff(np.r_[new, len(keys)])


def _exact(longest: int, shared: Broadcast):
    """Count the candidates of all sizes: lang, phrase (lower-cased words between blanks), k, n."""

    def run(batches: Iterator[pa.RecordBatch]):
        table = shared.value
        for batch in B.portions(batches, "text", 1 << 22):
            raw, starts, ends, hashes, piece, text = _read(batch)
            if not len(starts):
                continue
            group = batch.column("lang_key").to_numpy().view(np.uint64)[text]
            low = B.LOWER[raw].tobytes()
            for k in range(1, longest + 1):
                places, keys = _grams(hashes, piece, text, k)
                good = _has(table, _slot(group[places], keys))
                places, keys = places[good], keys[good]
                if not len(keys):
                    continue
                new, n = _first(group[places], keys)
                there = places[new]
                spans = [zip(starts[there + j].tolist(), ends[there + j].tolist(), strict=True) for j in range(k)]
                phrases = [b" ".join([low[a:b] for a, b in x]) for x in zip(*spans, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(text[there])), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(there), k, np.int32)), pa.array(n)], ["lang", "phrase", "k", "n"])

    return run


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, shards: int = 4) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``min_count`` times in a language, with exact counts; and the words of each language.

    SON in two phases.  Every document belongs to one of ``shards`` shards, by the hash of its
    text.  Each shard is mined completely, level by level, at the local support
    min_count * (words of the language in the shard) / (words of the language), rounded
    up: a phrase below it in every shard is below ``min_count`` as a whole.  A phrase is counted in
    a shard only if all its parts of the level before are frequent there.  The locally frequent phrases of all shards
    are then counted over all documents, by their words.  A shard is a group of counts, not a task: its
    counting is spread over all tasks and combined before the shuffle.  What
    thins out phrases before counting is a table of BITS bits, so the broadcast does not grow;
    hashes that meet there only add candidates.

    Tables: lang, phrase, k, n; and lang_key (hash of lang), total.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("lang", "text", F.xxhash64("lang").alias("lang_key"), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int").alias("shard"))
    group = F.xxhash64("lang_key", "shard")
    keyed = keyed.withColumn("grp", group)
    context = docs.sparkSession.sparkContext

    def count(sizes: tuple[int, ...], table, below: int) -> DataFrame:
        mined = keyed.select("lang_key", "shard", "grp", "text").mapInArrow(_mine(sizes, table, below), "lang_key long, shard int, gram long, n long")
        return mined.groupBy("lang_key", "shard", "gram").agg(F.sum("n").alias("n"))

    words = held(count((1,), None, 1))
    shares = words.groupBy("lang_key", "shard").agg(F.sum("n").alias("own"))
    totals = held(shares.groupBy("lang_key").agg(F.sum("own").alias("total")))
    support = held(shares.join(totals, "lang_key").select("lang_key", "shard", F.ceil(F.lit(min_count).cast("decimal(10,0)") * F.col("own") / F.col("total")).cast("long").alias("least")))
    local = lambda counts: held(counts.join(support, ["lang_key", "shard"]).where("n >= least").select("lang_key", "shard", "gram"))

    levels = [local(words)]
    below = 1
    for sizes in [(k,) for k in range(2, min(longest, 3) + 1)] + ([tuple(range(4, longest + 1))] if longest > 3 else []):
        table = context.broadcast(_bits(_slots(levels[-1], group)))
        levels.append(local(count(sizes, table, below)))
        table.destroy()
        below = sizes[-1]

    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    table = context.broadcast(_bits(_slots(found, F.col("lang_key"))))
    counted = keyed.select("lang", "lang_key", "text").mapInArrow(_exact(longest, table), "lang string, phrase string, k int, n long")
    exact = held(counted.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    table.destroy()
    return exact, totals


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, best: int = 2000, shards: int = 4) -> DataFrame:
    """The phrases of 2 to ``longest`` words of each language whose words stand together most beyond chance.

    Words are what stands between blanks, A-Z as a-z, in pieces that punctuation and line ends
    cut.  A phrase that occurs a times, and whose first k words occur l and the others r times, scores
    floor(1000 a n / (l r)) at that cut, n being the words of the language; the lowest cut counts (ties: the smallest
    k).  Scores are worked out in decimals and whole numbers.  A phrase goes if it stands in a longer
    frequent phrase that occurs as often.  Phrases come from ``frequent_phrases``; each of their parts is one too, so
    all counts are there.  ``best`` of each language by score, a (both falling) and
    phrase (in the order of its bytes) are the report.

    Null text is empty, a null language und; ids are not looked at and repeated rows count
    each; texts without words have no phrases, an empty table gives no rows; a very long
    text is worked off by one task; other columns are not looked at, whatever their names.
    Columns: lang, rank, phrase, a, l, r, n, score.
    """
    counts, totals = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, longest=longest, min_count=min_count, shards=shards)
    return scored(counts, totals, best=best)


def scored(counts: DataFrame, totals: DataFrame, *, best: int) -> DataFrame:
    """Score the phrases of the tables of ``frequent_phrases`` at their lowest cut, without those that stand in longer ones as often (see collocations)."""
    parts = F.split("phrase", " ")
    phrases = counts.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k", parts.alias("words"))
    joined = lambda first, size: F.array_join(F.slice("words", first, size), " ")

    longer = phrases.where("k > 2").select("lang", "a", "k", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inside = longer.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first")).select("lang", joined(F.col("first"), F.col("size")).alias("phrase"), "a")
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    own = phrases.join(covered, ["lang", "phrase"], "left").where("most IS NULL OR most < a")

    cuts = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k", "words")
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda c, n: counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("lang_key", F.xxhash64("lang")).join(totals, "lang_key")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * wide("total"), wide("l") * wide("r"))
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = lowest.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("total").alias("n"), F.col("x.score").alias("score"))
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {
    "op11_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(t, '[.,;:!?
-
]')), '[ 	]+'), lambda w: w <> '') AS ws FROM t),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
totals AS (SELECT lang, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
sub AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY 1, 2),
own AS (SELECT c.* FROM c LEFT JOIN sub ON sub.lang = c.lang AND sub.phrase = c.phrase WHERE sub.most IS NULL OR sub.most < c.a),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM own),
sc AS (SELECT cut.lang, cut.phrase, cut.a, cut.c, x.a AS l, y.a AS r, n, ((1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
       FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.ws[1 : cut.c], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.ws[cut.c + 1 :], ' ') JOIN totals ON totals.lang = cut.lang),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low QUALIFY rank <= 2000
"""
}
