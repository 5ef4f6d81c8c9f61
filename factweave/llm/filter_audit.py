"""Operator 12: filter interaction audit by the potential of the removal game."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words stand between these: the ASCII white space.
_BLANKS = r"[ \t-\r]+"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on a text and the array of its words: A too short, B repetitive, C upper case, D signs of markup."""
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=text_filters, copies: str | None = "E") -> tuple[DataFrame, str]:
    """Number of documents by part, set of filters that they fail, and labels: part, fails (a bit for each filter, the first lowest), good, toxic, n; and the letters of the filters.

    ``copies`` names the filter that a text fails if a smaller id has the same one.
    The smallest id of a text is found with partial aggregation and joined back by text
    and id, so a text that a third of all documents share is no hot key.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = texts.select("*", F.array_remove(F.split("text", _BLANKS), "").alias("words"))
    failed = filters(F.col("text"), F.col("words"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failed.values())]
    rows = split.select("id", "part", sum(bits[1:], bits[0]).alias("fails"), F.sha2("text", 256).alias("name"))
    letters = "".join(failed)
    if copies:
        first = rows.groupBy("name").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
        again = F.when(F.col("first").isNull() & F.col("id").isNotNull(), F.lit(1 << len(letters))).otherwise(F.lit(0))
        rows = rows.join(first, ["name", "id"], "left").withColumn("fails", F.col("fails") + again)
        letters += copies
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = rows.join(marks, "id", "left")
    return marked.groupBy("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))).agg(F.count("*").alias("n")), letters


def coalitions(counts: DataFrame, k: int) -> DataFrame:
    """What each of the 2^k sets of filters removes, by part: n, and arrays v, good, toxic, whose place is the set's bits.

    A row for each part: the counts have 2^k sets of failures at most, and each meets 2^k sets of filters.
    """
    met = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("s"))
    hit = F.when(F.col("fails").bitwiseAND(F.col("s")) != 0, F.col("n")).otherwise(F.lit(0))
    worth = met.groupBy("part", "s").agg(F.sum("n").alias("n"), F.sum(hit).alias("v"), F.sum(F.when(F.col("good"), hit).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), hit).otherwise(0)).alias("toxic"))
    line = F.array_sort(F.collect_list(F.struct("s", "v", "good", "toxic")))
    return worth.groupBy("part").agg(F.max("n").alias("n"), line.alias("x")).select("part", "n", *(F.col(f"x.{c}").alias(c) for c in ("v", "good", "toxic")))


def potentials(worth: Column, k: int) -> Column:
    """The potential of each set of filters, times k!, as an array like ``worth``.

    The potential of the empty game is 0; that of a set is its worth and the potentials
    of the sets without one of its filters, over its size.  Times k! all of them are whole
    numbers, so nothing is rounded.  Sets come after those they are made of.
    """

    def of(known: Column, s: Column) -> Column:
        less = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(known, s - F.lit(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(k)]
        total = F.get(worth, s) * F.lit(factorial(k)) + sum(less[1:], less[0])
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(s).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), of)


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=text_filters, copies: str | None = "E") -> DataFrame:
    """How filters act together, by part of the corpus, in every order that they can be applied in.

    The game: a set of filters is worth the documents that it removes.  Documents are
    counted once by the set of filters that they fail; the worth of all sets, and with the
    recursion of ``potentials`` each filter's Shapley value (the potential of all filters
    less that without it), follow from these few counts.  A step of an order is the difference of
    two sets: the filters up to it and those before it.

    Rows for each part, order (the filters' letters from first to last) and step (from 1):
    kept after the step, removed by it, redundant (fail its filter, removed before),
    unique_fails (fail its filter alone), good_lost and toxic_lost (removed by it, with the label),
    shapley (removed by its filter, summed over all orders: k! Shapley values).

    Null text is empty, a null part the empty string.  A row without id repeats no other and is
    repeated by none; rows that share the smallest id of a text keep it all; repeated rows count each.
    Labels with a null id, or null, mark nothing; of several labels of an id one has to hold.
    An empty table has no parts and gives no rows; a very long text is one row's work; other
    columns are not looked at, whatever their names.
    """
    counts, letters = judged(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col, filters=filters, copies=copies)
    k = len(letters)
    grand = (1 << k) - 1
    parts = coalitions(counts, k).withColumn("p", potentials(F.col("v"), k))
    walked = parts.select("*", F.explode(F.array(*(F.lit("".join(o)) for o in permutations(letters)))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bits = lambda text: sum((F.when(F.instr(text, c) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(letters)), F.lit(0))
    steps = walked.withColumn("own", bits(F.substring("filter_order", F.col("step"), 1))).withColumn("before", bits(F.substring("filter_order", 1, F.col("step") - 1)))
    own, before = F.col("own"), F.col("before")
    after = before + own
    removed = F.get("v", after) - F.get("v", before)
    lost = lambda c: F.get(c, after) - F.get(c, before)
    without = F.lit(grand) - own
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.get("v", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("v", own) - removed).alias("redundant"),
        (F.get("v", F.lit(grand)) - F.get("v", without)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (F.get("p", F.lit(grand)) - F.get("p", without)).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE_SQL = {
    "op12_filter_audit": """
WITH first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS m FROM documents GROUP BY 1),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT part, len(ws) < 100 AS A, 100 * len(list_distinct(ws)) < 80 * len(ws) AS B, 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 10 * length(w.t) AS C,
             regexp_matches(w.t, '[#$%&*|]') AS D, coalesce(w.doc_id > first.m, false) AS E, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w JOIN first ON w.t = first.t LEFT JOIN marks ON w.doc_id = marks.doc_id),
c AS (SELECT part, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS m, count(*) AS n, count_if(good) AS g, count_if(toxic) AS x FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
t AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (m & (before | own) = 0) AS kept, sum(n) FILTER (m & own > 0 AND m & before = 0) AS removed, sum(n) FILTER (m & own > 0 AND m & before > 0) AS redundant,
             sum(n) FILTER (m = own) AS unique_fails, sum(g) FILTER (m & own > 0 AND m & before = 0) AS good_lost, sum(x) FILTER (m & own > 0 AND m & before = 0) AS toxic_lost FROM c, t GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""
}
