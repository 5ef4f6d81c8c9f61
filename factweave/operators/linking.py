"""Which processes a document's materials go through, in four passes: listed or named together, near each other, by scores, by related names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from factweave.functions import values as V
from factweave.operators.entities import _grams
from factweave.store import kept

#: How far from a process's name, on either side, a material's name is near it; and the width of the blocks by which mentions meet.
NEAR, BLOCK = 450, 1024


@pandas_udf(ArrayType(StructType().add("name", StringType()).add("at", IntegerType())))
def found_at(text: pd.Series, names: pd.Series) -> pd.Series:
    """Every place, overlapping ones included, where a text holds one of some names."""

    def places(t: str, wanted):
        out = []
        for name in wanted:
            at = t.find(name)
            while at >= 0:
                out.append({"name": name, "at": at})
                at = t.find(name, at + 1)
        return out

    return pd.Series([places(t or "", w if w is not None else ()) for t, w in zip(text, names, strict=True)])


def _meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the documents: by shuffle, whatever size Spark takes them for.

    A stored table of names is small as a file and may be a hundred times that as rows, which a broadcast would put into the driver.
    """
    return a.join(b.hint("merge"), on, how)


def material_terms(name: Column, aliases: Column) -> Column:
    """The words of a material's names, of three characters or more, that tell it."""
    parts = F.flatten(F.transform(F.concat(F.array(name), aliases), lambda f: F.split(F.lower(f), r"[\s\-/,]+")))
    return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda t: (F.length(t) >= 3) & ~t.isin(V.MATERIAL_TERM_STOP)))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Where the texts (doc_id, text) of documents hold their names (doc_id, name in lower case): doc_id, name, at."""
    asked = names.where("name <> ''").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    return _meet(texts, asked, ["doc_id"]).select("doc_id", F.explode(found_at(F.lower("text"), F.col("names"))).alias("x")).select("doc_id", "x.name", "x.at")


def near_mentions(places: DataFrame, others: DataFrame, near: int = NEAR) -> DataFrame:
    """Pairs of names (doc_id, name, other) of which one place of the other lies wholly within ``near`` characters around one place of the first.

    Places meet by blocks of the text, so a name that is everywhere meets what is in its blocks and no more.
    """
    low, high = F.greatest(F.col("at") - near, F.lit(0)), F.col("at") + F.length("name") + near
    spread = places.select("doc_id", "name", low.alias("low"), high.alias("high")).select("*", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))).alias("block"))
    there = others.select("doc_id", F.col("name").alias("other"), "at", F.floor(F.col("at") / BLOCK).alias("block"))
    return _meet(spread, there, ["doc_id", "block"]).where((F.col("at") >= F.col("low")) & (F.col("at") + F.length("other") <= F.col("high"))).select("doc_id", "name", "other").distinct()


def _inside(needles: DataFrame, stacks: DataFrame) -> DataFrame:
    """Rows of needles (doc_id, needle, ...) and stacks (doc_id, stack, ...) of a document where the stack holds the needle; they meet by the needle's first three characters."""
    grams = stacks.select("*", F.explode(_grams(F.col("stack"))).alias("gram"))
    return _meet(needles.where("needle <> ''").withColumn("gram", F.substring("needle", 1, 3)), grams, ["doc_id", "gram"]).where(F.contains("stack", F.col("needle")))


def material_processes(
    materials: DataFrame, processes: DataFrame, texts: DataFrame, *, stage_words: Mapping[str, Sequence[str]] = V.STAGE_WORDS, name_hints: Mapping[str, Sequence[str]] = V.NAME_HINTS, near: int = NEAR
) -> DataFrame:
    """Link materials (doc_id, seq, name, aliases, stage) to processes (doc_id, seq, process_id, name, aliases, listed) of their document (texts: doc_id, text): doc_id, material, process_id, way.

    1. ``listed``: the process lists the material by name or alias (of several with the name the last);
       ``named``: one name holds the other, or the process's names hold a word of the material;
       ``near``: the text has the material's name or a word of it within ``near`` characters of a name of the process.
    2. ``score``: a material that is still without takes the process with the largest score, from 2 on: 1.2 for each
       word of its stage and 2 for each hint of its name that the process's names hold (names, words and
       nearness, which count in a score too, are nil here, as pass 1 would have linked them).  The first of equals.
    3. ``related``: one that is still without takes the process of the first linked material whose name holds
       its own or is held by it; those linked here come after the others and count for the next.
    4. ``last``: what is left takes the process with the largest score above 0.

    Names are compared in lower case, those of a list also as their capitals are.  A name that comes twice in a document is one material, the last
    one.  Nothing is compared across documents; within one, names meet by their
    first characters, mentions by blocks of the text, scores by words, and pass 3 folds the list of a document's materials.
    """
    empty = F.array().cast("array<string>")
    lowered = lambda c: F.transform(F.coalesce(c, empty), F.lower)
    last = materials.where(F.trim("name") != "").groupBy("doc_id", F.lower("name").alias("low")).agg(F.max_by(F.struct("seq", "name", "aliases", "stage"), "seq").alias("m"))
    m = kept(last.select("doc_id", "low", "m.seq", "m.name", lowered(F.col("m.aliases")).alias("aliases"), "m.stage").withColumn("terms", material_terms(F.col("low"), F.col("aliases"))))
    p = processes.select("doc_id", F.col("seq").alias("at"), "process_id", F.filter(F.concat(F.array(F.lower(F.coalesce("name", F.lit("")))), lowered(F.col("aliases"))), lambda n: n != "").alias("names"), F.coalesce("listed", empty).alias("listed"))
    p = kept(p)
    named = p.select("doc_id", "at", "process_id", F.explode("names").alias("stack"))

    # Pass 1, with what orders the links: the process, then its list, then the materials.
    # A letter that two stand for in capitals (ß) is the same as those two; a name with the very letters goes before. Spark takes lower(upper(x)) for lower(x), hence the concat.
    own = F.array_distinct(F.concat(F.array("low"), "aliases"))
    spelt = F.concat(F.transform(own, lambda k: F.struct(k.alias("key"), F.lit(1).alias("exact"))), F.transform(own, lambda k: F.struct(F.lower(F.concat(F.upper(k), F.lit(""))).alias("key"), F.lit(0).alias("exact"))))
    keys = m.select("doc_id", "low", "seq", F.explode(spelt).alias("k")).groupBy("doc_id", F.col("k.key").alias("key")).agg(F.max_by("low", F.struct("k.exact", "seq")).alias("low"))
    listed = _meet(p.select("doc_id", "at", "process_id", F.posexplode("listed").alias("place", "raw")).withColumn("key", F.lower(F.trim("raw"))), keys, ["doc_id", "key"])
    listed = listed.select("doc_id", "low", "at", "process_id", F.lit(0).alias("rank"), "place")
    words = m.select("doc_id", "low", "seq", F.explode(F.array_distinct(F.concat(F.array("low"), "terms"))).alias("needle"))
    other = named.select("doc_id", F.col("stack").alias("needle"), "at", "process_id")
    names = _inside(words, named).select("doc_id", "low", "at", "process_id", "seq").union(_inside(other, m.select("doc_id", "low", "seq", F.col("low").alias("stack"))).select("doc_id", "low", "at", "process_id", "seq"))
    names = names.select("doc_id", "low", "at", "process_id", F.lit(1).alias("rank"), F.col("seq").alias("place"))
    places = kept(mentions(texts, words.select("doc_id", F.col("needle").alias("name")).union(named.select("doc_id", "stack")).distinct()))
    of = lambda df, c: _meet(places, df.select("doc_id", F.col(c).alias("name")).distinct(), ["doc_id", "name"], "left_semi")
    met = near_mentions(of(named, "stack"), of(words, "needle"), near)
    beside = _meet(_meet(met, named.withColumnRenamed("stack", "name"), ["doc_id", "name"]), words.withColumnRenamed("needle", "other"), ["doc_id", "other"])
    beside = beside.select("doc_id", "low", "at", "process_id", F.lit(2).alias("rank"), F.col("seq").alias("place"))
    first = kept(listed.union(names).union(beside).groupBy("doc_id", "low", "at", "process_id").agg(F.min(F.struct("rank", "place")).alias("r")))

    # Pass 2: only words of stages and hints can still score.
    free = kept(_meet(m, first.select("doc_id", "low").distinct(), ["doc_id", "low"], "left_anti"))
    holds = lambda word: F.exists("names", lambda n: F.contains(n, F.lit(word)))
    of_stage = F.array_compact(F.array(*(F.when(holds(w), F.struct(F.lit(f"stage {s}").alias("key"), F.lit(1.2).alias("points"))) for s, ws in stage_words.items() for w in ws)))
    any_word = lambda ws: F.exists("names", lambda n: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(n, w)))
    of_hint = F.array_compact(F.array(*(F.when(any_word(ws), F.struct(F.lit(f"hint {h}").alias("key"), F.lit(2.0).alias("points"))) for h, ws in name_hints.items())))
    offers = p.select("doc_id", "at", "process_id", F.explode(F.concat(of_stage, of_hint)).alias("x")).select("doc_id", "at", "process_id", "x.key", "x.points")
    hints = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(h)) | F.array_contains("terms", h), F.lit(f"hint {h}")) for h in name_hints)))
    wants = free.select("doc_id", "low", "seq", F.explode(F.concat(F.array(F.concat(F.lit("stage "), F.coalesce("stage", F.lit("")))), hints)).alias("key"))
    sums = _meet(wants, offers, ["doc_id", "key"]).groupBy("doc_id", "low", "seq", "at", "process_id").agg(F.round(F.sum("points"), 6).alias("score"))
    best = kept(sums.groupBy("doc_id", "low", "seq").agg(F.min(F.struct((-F.col("score")).alias("s"), "at", "process_id")).alias("b")).select("doc_id", "low", "seq", (-F.col("b.s")).alias("score"), F.col("b.process_id").alias("process_id")))
    scored = best.where("score >= 2")

    # Pass 3: the linked ones in the order of their first link, with the process of their last.
    one, two = F.lit(1), F.lit(2)
    rows = first.select("doc_id", "low", F.struct(one.alias("pass"), F.col("at").cast("long").alias("a"), F.col("r.rank").alias("b"), F.col("r.place").cast("long").alias("c")).alias("o"), "process_id")
    rows = rows.union(scored.select("doc_id", "low", F.struct(two.alias("pass"), F.col("seq").cast("long").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c")).alias("o"), "process_id"))
    linked = rows.groupBy("doc_id", "low").agg(F.min("o").alias("o"), F.max_by("process_id", "o").alias("process_id"))
    lines = linked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "low", "process_id"))), lambda x: F.struct(x["low"].alias("low"), x["process_id"].alias("process_id"))).alias("linked"))
    still = _meet(free, scored.select("doc_id", "low"), ["doc_id", "low"], "left_anti").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "low"))), lambda x: x["low"]).alias("free"))

    def inherit(known: Column, name: Column) -> Column:
        source = F.get(F.filter(known, lambda k: F.contains(name, k["low"]) | F.contains(k["low"], name)), F.lit(0))
        return F.when(source.isNull(), known).otherwise(F.concat(known, F.array(F.struct(name.alias("low"), source["process_id"].alias("process_id")))))

    grown = _meet(still, lines, ["doc_id"]).select("doc_id", F.size("linked").alias("n"), F.aggregate("free", F.col("linked"), inherit).alias("all"))
    related = kept(grown.select("doc_id", F.explode(F.slice("all", F.col("n") + 1, F.greatest(F.size("all") - F.col("n"), F.lit(0)))).alias("x")).select("doc_id", "x.low", "x.process_id"))
    final = _meet(best.where("score < 2"), related.select("doc_id", "low"), ["doc_id", "low"], "left_anti")

    way = F.get(F.array(F.lit("listed"), F.lit("named"), F.lit("near")), F.col("r.rank"))
    out = first.select("doc_id", "low", "process_id", way.alias("way"))
    for df, name in ((scored, "score"), (related, "related"), (final, "last")):
        out = out.union(df.select("doc_id", "low", "process_id", F.lit(name)))
    return _meet(out, m.select("doc_id", "low", "name"), ["doc_id", "low"]).select("doc_id", F.col("name").alias("material"), "process_id", "way")
