"""Operator 6: n-gram Jaccard join by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesets as B
from .components import bit_table, components, held

#: Counters of the frequency sketch and slots of the table of wanted documents; neither depends on the data.
COUNTERS, BLOCK, SLOTS = 1 << 20, 1 << 12, 1 << 22
#: Words of 64 parities that stand for a set.
WORDS = ("w0", "w1", "w2", "w3")


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row: k words each, or all words of a shorter text."""
    raw, at = B.buffers(batch.column("text"))
    *_, hashes, first = B.words(raw, at, B.NONSPACE)
    whole = B.grams(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(whole[a : b - k + 1] if b - a >= k else B.grams(hashes[a:b], b - a)) if b > a else whole[:0]


def _signature(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int((B.mix(shingles ^ np.uint64(0xA24BAED4963EE407)).sum() + np.uint64(len(shingles))).view(np.int64))


def _parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * len(WORDS) bins whether an odd number of shingles falls into it, as signed words."""
    bins = (B.mix(shingles) % np.uint64(64 * len(WORDS))).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=64 * len(WORDS)) & 1).astype(np.uint8)).view(np.int64)


def _bins(shingles: np.ndarray) -> bytes:
    """The same parities with as many bins as the set has shingles, up to a power of two: close to the true difference at every size."""
    bins = max(64, 1 << (len(shingles) - 1).bit_length())
    places = (B.mix(shingles ^ np.uint64(0x632BE59BD9B4E019)) & np.uint64(bins - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bins) & 1).astype(np.uint8), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """In how many bins two sets' parities differ; more bins are folded to as few as the other has."""
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in (a, b))
    return int(np.unpackbits(a ^ b).sum())


def _may_link(percent: int):
    """(a, b): the pairs whose parities allow the similarity (see _near_parities)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            most = (100 - percent) * (batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            differ = [_differ(x.as_py(), y.as_py()) for x, y in zip(batch.column("ba"), batch.column("bb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * np.array(differ, np.int64) <= most))

    return run


def _members(k: int):
    """A row (id, sig, n, parities, bins) for each document, and at the end of the task its frequency sketch in blocks."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts, kind = np.zeros(COUNTERS, np.uint32), None
        for batch in B.portions(batches, "text"):
            sigs, sizes, kind = [], [], batch.schema.field("id").type
            found = list(_sets(batch, k))
            for s in found:
                sigs.append(_signature(s) if len(s) else None)
                sizes.append(len(s))
            bins = pa.array([_bins(s) if len(s) else None for s in found], pa.binary())
            every = np.concatenate(found)
            words = np.array([_parities(s) for s in found]).T
            counts += np.bincount((every >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(w) for w in words), bins, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["id", "sig", "n", *WORDS, "bins", "block", "counts"])
        if kind is not None:
            codec = pa.Codec("zstd", 1)
            blocks = [codec.compress(x.tobytes()).to_pybytes() for x in counts.reshape(-1, BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), *[pa.nulls(n, pa.int64())] * (2 + len(WORDS)), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(blocks, pa.binary())], ["id", "sig", "n", *WORDS, "bins", "block", "counts"])

    return run


def _add_blocks(table: pa.Table) -> pa.Table:
    codec, total = pa.Codec("zstd"), np.zeros(BLOCK, np.uint64)
    for x in table.column("counts"):
        total += np.frombuffer(codec.decompress(x.as_py(), BLOCK * 4), np.uint32)
    level = np.minimum(np.round(10 * np.log2(total + 1.0)), 65535).astype(np.uint16)
    return pa.table({"block": table.column("block")[:1], "levels": pa.array([level.tobytes()], pa.binary())})


def _ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set in the global order: rarest first by the sketch, then by hash."""
    return shingles[np.lexsort((shingles, levels[(shingles >> np.uint64(44)).astype(np.int64)]))]


def _postings(k: int, percent: int, levels):
    """(key, sig, n, pos) for the prefix of each set; a set that the task has had is left out."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[int] = set()
        for batch in B.portions(batches, "text"):
            keys, sigs, sizes, places = [], [], [], []
            for s in _sets(batch, k):
                sig = _signature(s) if len(s) else None
                if sig is None or sig in seen:
                    continue
                seen.add(sig)
                p = len(s) - -(-percent * len(s) // 100) + 1
                keys.append(_ordered(s, levels.value)[:p])
                sigs.append(np.full(p, sig, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(np.concatenate(keys))), *(pa.array(np.concatenate(x)) for x in (sigs, sizes, places))], ["key", "sig", "n", "pos"])

    return run


def _only(table):
    """(id, text) of the rows whose slot is set."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.select(["id", "text"]).filter(pa.array(table.value[batch.column("slot").to_numpy()]))

    return run


def _cuts(levels: np.ndarray, parts: int) -> np.ndarray:
    """The fragment of each counter of the sketch, where the global order (rarest first, then by hash) is cut into ``parts`` of about as many occurrences."""
    order = np.lexsort((np.arange(len(levels)), levels))
    mass = np.cumsum(np.exp2(levels[order] / 10.0) - 1)
    fragment = np.empty(len(levels), np.uint8)
    fragment[order] = np.minimum(parts - 1, mass * parts / max(mass[-1], 1)).astype(np.uint8)
    return fragment


def _fragments(k: int, cuts):
    """(sig, part, n, shingles): the sets of documents by fragment of the global order; n is the size of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text"):
            sigs, fragment, sizes, pieces = [], [], [], []
            for s, wanted in zip(_sets(batch, k), batch.column("sig").to_pylist(), strict=True):
                if not len(s) or _signature(s) != wanted:
                    continue
                part = cuts.value[(s >> np.uint64(44)).astype(np.int64)]
                for f in np.unique(part):
                    sigs.append(wanted)
                    fragment.append(f)
                    sizes.append(len(s))
                    pieces.append(B.signed(s[part == f]))
            if pieces:
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces)))
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(fragment, pa.int32()), pa.array(sizes, pa.int64()), lists], ["sig", "part", "n", "shingles"])

    return run


def _fits(a: str, b: str, percent: int):
    """Whether sizes and places leave room for the similarity, if this shingle is the first in the global order that both sets have.

    The overlap needed is percent / (100 + percent) of both sizes; it lies at and
    after the first common shingle, and a similar pair has that one in both
    prefixes, so it is met there even where its later shingles are turned down.
    """
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    room = F.least(na - pa_, nb - pb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * room >= percent * (na + nb))


def _near_parities(a: str, b: str, percent: int):
    """Whether the parities allow the similarity.

    A shingle that only one of two sets has turns one parity, so parities that
    differ are at most as many as such shingles, and similar sets have no more
    of them than (100 - percent) / (100 + percent) of both sizes.
    """
    differ = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _mixed(postings: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Entries (key, me, c: the component so far) of shingles that are in different components so far."""
    if groups is None:
        return postings.withColumn("c", F.col("me.sig"))
    own = postings.withColumn("s", F.col("me.sig")).join(groups, "s", "left").select("key", "me", F.coalesce("component", "s").alias("c"))
    mixed = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    return own.join(mixed, "key", "left_semi")


def _drawn(join: "_Join", rest: DataFrame, turn: int, most: int = 2) -> DataFrame:
    """For each set up to ``most`` others (a, b) that stand before it in the lists' drawn orders, those that do so most often."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "me.sig", F.lit(turn)))
    met = rest.withColumns({"you": F.lag("me").over(order), "d": F.lag("c").over(order)})
    fit = met.where((F.col("c") != F.col("d")) & _fits("me", "you", join.percent))
    counted = fit.groupBy(F.col("me.sig").alias("x"), F.col("you.sig").alias("y")).count()
    best = counted.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "y")), False), 1, most).alias("m"))
    return best.select("x", F.explode("m").alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b"))


class _Join:
    """The sets of one table and how pairs of them are verified."""

    def __init__(self, texts: DataFrame, k: int, percent: int, parts: int):
        self.texts, self.k, self.percent, self.parts = texts, k, percent, parts
        id_type = texts.schema["id"].dataType.simpleString()
        self.id_type = id_type
        made = held(texts.mapInArrow(_members(k), f"id {id_type}, sig long, n long, {', '.join(f'{w} long' for w in WORDS)}, bins binary, block int, counts binary"))
        self.members = made.where("block IS NULL").select("id", "sig", "n")
        levels = np.zeros(COUNTERS, np.uint16)
        for r in made.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_add_blocks, "block int, levels binary").toLocalIterator():
            levels[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.levels, np.uint16)
        self.levels = texts.sparkSession.sparkContext.broadcast(levels)
        self.cuts = texts.sparkSession.sparkContext.broadcast(_cuts(levels, parts))
        first = [F.first(c).alias(c) for c in ("n", *WORDS, "bins")]
        self.sets = held(made.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("id"), *first))

    def postings(self) -> DataFrame:
        """Prefix entries whose shingle another set has in its prefix too."""
        rows = self.texts.mapInArrow(_postings(self.k, self.percent, self.levels), "key long, sig long, n int, pos int")
        order = Window.partitionBy("key").orderBy("sig")
        seen = rows.select("key", "sig", "n", "pos", F.lag("sig").over(order).alias("before"), F.lead("sig").over(order).alias("after"))
        return seen.where((F.col("before") != F.col("sig")) | (F.col("after") != F.col("sig")))

    def pairs(self, rows: DataFrame, a: str, b: str) -> DataFrame:
        fit = rows.where(F.col(f"{a}.sig") != F.col(f"{b}.sig"))
        return fit.select(F.least(f"{a}.sig", f"{b}.sig").alias("a"), F.greatest(f"{a}.sig", f"{b}.sig").alias("b"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar.

        Pairs that their parities rule out go first.  Of the rest, overlaps are
        counted fragment by fragment and added up for each pair.  Sides that grow
        with the input are merged at every size.
        """
        side = lambda c: self.sets.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("bins").alias(f"b{c}"))
        pairs = held(pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").mapInArrow(_may_link(self.percent), "a long, b long"))
        ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
        wanted = held(ends.hint("merge").join(self.sets.select("sig", "id"), "sig"))
        slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")
        shared = self.texts.sparkSession.sparkContext.broadcast(bit_table(wanted.select(slot.alias("slot")), SLOTS))
        some = self.texts.withColumn("slot", slot).mapInArrow(_only(shared), f"id {self.id_type}, text string")
        texts = some.join(wanted.hint("merge"), "id").dropDuplicates(["id", "sig", "text"])
        sets = held(texts.mapInArrow(_fragments(self.k, self.cuts), "sig long, part int, n long, shingles array<long>"))
        shared.unpersist()
        side = lambda c: sets.select(F.col("sig").alias(c), "part", F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}"))
        both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), ["b", "part"])
        # A row that repeats an id may repeat its set, so a fragment counts once.
        overlap = both.select("a", "b", "part", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("c")).groupBy("a", "b", "part").agg(F.max("c").alias("c"), F.max(F.col("na") + F.col("nb")).alias("n"))
        total = overlap.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
        return total.where(100 * F.col("c") >= self.percent * (F.col("n") - F.col("c"))).select("a", "b")


def ngram_jaccard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, parts: int = 4, turns: int = 3) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their word shingles.

    Sets of ``k``-word shingles (words between white space, A-Z lower-cased; a
    shorter text is one shingle) link when 100 * intersection >= ``percent`` *
    union.  Equal sets are one set from the start, named by a 64-bit hash.
    Shingles have one global order: rarest first by a frequency sketch of fixed
    size that counts all documents, then by hash.  Similar sets share a shingle
    of their prefixes (percent / 100 of the set has to be common), so frequent
    passages, last in order, bring nothing together.

    First each set is compared with two others at most that it meets in lists of
    prefix entries, and so in up to ``turns`` turns while sets in different components
    meet: pairs in proportion to the sets, however long the lists.  Pairs
    whose parities (of as many bins as a set has shingles) differ too often are no links; for the others the
    global order is cut into ``parts`` fragments; the overlaps of a pair are
    counted fragment by fragment and summed.  The links give components.  Then all
    pairs of prefix entries in different components are compared that length,
    position and the parities of both sets' bins allow: pairs inside a component cannot change the classes, so none
    that matters is left out.

    Null and empty texts have the empty set and link with nothing; rows that
    repeat an id are one node (rows stay); rows with a null id link like others, and a
    component has a null id only if it has no other; ties (equal sets) are one set
    under the smallest id; an empty table gives no rows; a very long text is a row of
    a batch of its own, its words worked off in blocks; other
    columns are not looked at, whatever their names.  Columns: id, n_shingles,
    component_id (smallest id reachable).
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    join = _Join(texts, k, percent, parts)
    postings = held(join.postings().select("key", F.struct("sig", "n", "pos").alias("me")).distinct())

    # Turns: each set meets, in lists that join different components so far, the entry before it in an order drawn anew for each list.
    links = tried = groups = None
    no_pairs = texts.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(turns):
        rest = held(_mixed(postings, groups))
        if rest.isEmpty():
            break
        near = _drawn(join, rest, turn).distinct()
        near = held(near if tried is None else near.join(tried, ["a", "b"], "left_anti"))
        found = held(join.links(near))
        tried = near if tried is None else held(tried.union(near))
        if turn and found.isEmpty():
            break
        links = found if links is None else held(links.union(found))
        groups = held(components(links)).withColumnRenamed("node", "s")

    rest = _mixed(postings, groups).withColumn("sig", F.col("me.sig")).join(join.sets.select("sig", *WORDS), "sig")
    rest = held(rest.select("key", F.struct("me.*", *WORDS).alias("me"), "c"))
    if not rest.isEmpty():
        other = rest.select("key", F.col("me").alias("you"), F.col("c").alias("d"))
        across = join.pairs(rest.select("key", "me", "c").join(other, (rest["key"] == other["key"]) & (F.col("c") < F.col("d")) & _fits("me", "you", percent) & _near_parities("me", "you", percent)), "me", "you").distinct()
        more = held(join.links(held(across.join(tried, ["a", "b"], "left_anti"))))
        if not more.isEmpty():
            groups = components(links.union(more)).withColumnRenamed("node", "s")
    groups = components(no_pairs) if groups is None else groups.withColumnRenamed("s", "node")
    named = join.members.join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("class", F.coalesce("component", "sig"))
    smallest = named.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("component_id"))
    return named.join(smallest, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_ngram_jaccard": op6_ngram_jaccard}
ORACLE_SQL: dict[str, str] = {}
