"""Operator 5: line dedup by a deletion-neighbourhood join (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import held


def _words(line: Column) -> Column:
    """The symbols of a line: lower-cased words between blanks."""
    return F.array_remove(F.split(F.lower(line), " "), "")


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """Lines with a word: id, ln (from 0), two hashes that name the line's class, and from ``least`` words on its half keys."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).select("id", "ln", _words(F.col("line")).alias("words"))
    lines = lines.withColumn("n", F.size("words")).where("n > 0")
    return lines.select("id", "ln", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"), F.when(F.col("n") >= least, _halves()).alias("keys"))


def _halves() -> Column:
    """Keys of which lines within one edit share one: the first or last half, cut for the line's own length and for one word more."""

    def key(m: Column, first: bool) -> Column:
        front = F.floor(m / 2).cast("int")
        back = m - front
        half = F.slice("words", F.lit(1), front) if first else F.slice("words", F.col("n") - back + 1, back)
        return F.xxhash64(m, F.lit(first), half)

    n = F.col("n")
    return F.array(*(key(m, first) for m in (n, n + 1) for first in (True, False)))


def _neighbours(lines: DataFrame) -> DataFrame:
    """For each line (id, ln, words), one of each class, the earliest other one within one word insertion, deletion or replacement, if that is earlier: id, ln, near.

    Every line emits the hash of each text with one word deleted, and of its
    whole text.  Lines with an equal variant at the same place differ in that
    word; a whole text that equals a variant differs by one word more or less.
    For each key the earliest lines are kept by minima (combined before the
    shuffle), so lines meet the earliest one instead of each other.
    """
    words = lines.select("id", "ln", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    line = Window.partitionBy("id", "ln")
    so_far = line.orderBy("i")
    marked = words.select("id", "ln", "n", "i", F.xxhash64("word", "i").alias("f"), F.xxhash64("word", F.col("i") - 1).alias("g")).withColumns(
        {
            "front": F.coalesce(F.bit_xor("f").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "until": F.bit_xor("g").over(so_far.rowsBetween(Window.unboundedPreceding, 0)),
            "all_f": F.bit_xor("f").over(line),
            "all_g": F.bit_xor("g").over(line),
        }
    )
    less = F.struct(F.col("front").bitwiseXOR(F.col("until")).bitwiseXOR(F.col("all_g")).alias("key"), (F.col("n") - 1).alias("m"), F.col("i").alias("i"))
    whole = F.struct(F.col("all_f").alias("key"), F.col("n").alias("m"), F.lit(-1).alias("i"))
    each = F.when(F.col("i") == 0, F.array(less, whole)).otherwise(F.array(less))
    variants = held(marked.select("id", "ln", F.explode(each).alias("v")).select("id", "ln", "v.*"))

    me = F.struct("id", "ln")
    met = variants.groupBy("key", "m").agg(F.min(me).alias("a"), F.max(me).alias("b")).where("a <> b").select("key", "m")
    variants = held(variants.join(met, ["key", "m"], "left_semi"))
    who = F.min(F.struct("id", "ln", "i")).alias("who")
    less, whole = variants.where("i >= 0"), variants.where("i < 0")
    pairs = [
        less.join(less.groupBy("key", "m", "i").agg(who), ["key", "m", "i"]),
        less.join(whole.groupBy("key", "m").agg(who), ["key", "m"]),
        whole.join(less.groupBy("key", "m").agg(who), ["key", "m"]),
    ]
    earlier = F.struct("who.id", "who.ln") < me
    first, second, third = (x.where(earlier).select("id", "ln", "i", "who") for x in pairs)
    found = first.unionByName(second).unionByName(third)
    checked = found.join(lines.select("id", "ln", "words"), ["id", "ln"]).join(
        lines.select(F.struct(F.col("id").alias("id"), F.col("ln").alias("ln")).alias("there"), F.col("words").alias("other")), F.struct("who.id", "who.ln") == F.col("there")
    )

    def without(array: str, i: Column) -> Column:
        return F.when(i < 0, F.col(array)).otherwise(F.concat(F.slice(array, F.lit(1), F.greatest(i, F.lit(0))), F.slice(array, F.greatest(i, F.lit(0)) + 2, F.size(array))))

    equal = without("words", F.col("i")) == without("other", F.col("who.i"))
    return checked.where(equal).groupBy("id", "ln").agg(F.min(F.struct("who.id", "who.ln")).alias("near"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop each line that repeats, within one word edit, a line that comes earlier in the corpus.

    Symbols are lower-cased words between blanks; lines without a word stay.  A
    line goes if the same words, or words within one insertion, deletion or
    replacement, stand in a line with a smaller (id, line number).  One edit is
    much of a short line (any word is one edit from any other), so the edit bound
    is 0 where one of the two lines has fewer than ``min_words`` words: such lines
    go if they repeat exactly.  Equal lines are put together first, so thousands of
    copies count once; only classes that share half of their words with another class can be
    within one edit, and only those emit their deletion neighbourhood (an exact
    condition: one edit leaves one half as it is).  Keys are hashes; every pair
    found is verified on its words.  All sides of the joins that grow with the
    corpus are merged or split by adaptive execution, and nothing comes to the driver.

    Null text is empty, and a text without words keeps all lines; rows that repeat
    an id are the same document and drop the same lines; lines of a null id are
    never dropped; an empty table gives no rows; a very long text is cut into lines
    in one task, a very long line into its words over a shuffle; other columns are
    not looked at, those in ``keep`` are handed on as kept_<name>, whatever their names.
    Columns: id, text (lines kept), n_lines, n_dropped.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    handed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    known = texts.where("id IS NOT NULL")
    lines = held(_lines(known, min_words))
    classes = held(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "ln")).alias("at"), F.count("*").alias("c"), F.any_value("keys").alias("keys")))
    halves = classes.select("h1", "h2", F.explode("keys").alias("half"))
    shared = halves.groupBy("half").count().where("count > 1")
    close = held(halves.join(shared, "half", "left_semi").select("h1", "h2").distinct().withColumn("close", F.lit(True)))
    wanted = held(classes.select("h1", "h2", "at", "c").join(close, ["h1", "h2"], "left").where("c > 1 OR close"))

    first = wanted.where("close").select(F.col("at.id").alias("id"), F.col("at.ln").alias("ln"))
    taken = known.dropDuplicates(["id"]).join(first.groupBy("id").agg(F.collect_set("ln").alias("lns")).hint("merge"), "id").select("id", F.explode("lns").alias("ln"), F.split("text", "\n").alias("parts"))
    near = held(_neighbours(held(taken.select("id", "ln", _words(F.get("parts", F.col("ln"))).alias("words")))))

    classes = wanted.join(near.select(F.struct("id", "ln").alias("at"), "near"), "at", "left").where("c > 1 OR near IS NOT NULL")
    here = F.struct("id", "ln")
    gone = lines.select("id", "ln", "h1", "h2").join(classes.select("h1", "h2", "at", "near"), ["h1", "h2"]).where((F.col("at") < here) | (F.col("near") < here))
    dropped = held(gone.groupBy("id").agg(F.collect_set("ln").alias("dropped")))
    parts = F.split("text", "\n")
    # Places left are found by hashing, so a text of many lines with many dropped ones costs in proportion to them.
    left = F.struct(parts.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "dropped").alias("at"))
    kept = F.get(F.transform(F.array(left), lambda x: F.transform(x["at"], lambda i: F.get(x["lines"], i))), F.lit(0))
    return handed.join(dropped.hint("merge"), "id", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *(f"kept_{c}" for c in keep),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
ORACLE_SQL = {
    "op5_line_dedup": """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM s),
l AS (SELECT doc_id, ln, line, list_filter(string_split(lower(line), ' '), lambda w: w <> '') AS ws FROM l0),
c AS (SELECT array_to_string(ws, ' ') AS k, any_value(ws) AS ws, min((doc_id, ln)) AS pos FROM l WHERE len(ws) > 0 GROUP BY 1),
v AS (SELECT k, pos, len(ws) - 1 AS m, i, array_to_string(list_concat(ws[1 : i - 1], ws[i + 1 :]), ' ') AS t FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c WHERE len(ws) >= 5)),
sub AS (SELECT k, min(pos) OVER (PARTITION BY t, m, i) AS near FROM v),
ins AS (SELECT v.k, c.pos AS near FROM v JOIN c ON v.t = c.k AND len(c.ws) >= 5),
del AS (SELECT c.k, v.pos AS near FROM v JOIN c ON v.t = c.k AND len(c.ws) >= 5),
n AS (SELECT k, min(near) AS near FROM (FROM sub UNION ALL FROM ins UNION ALL FROM del) GROUP BY k),
j AS (SELECT l.doc_id, l.ln, l.line, coalesce(c.pos < (l.doc_id, l.ln), false) OR coalesce(n.near < (l.doc_id, l.ln), false) AS gone
      FROM l LEFT JOIN c ON len(l.ws) > 0 AND c.k = array_to_string(l.ws, ' ') LEFT JOIN n ON n.k = c.k)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '')) AS text_sha256 FROM j GROUP BY doc_id
"""
}
