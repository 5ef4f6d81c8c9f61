"""Operator 13: removal of repeated byte strings by sorting sampled suffixes, shallow and deep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets as B
from .components import held

#: Depth in bytes down to which multikey quicksort orders; blind tries order what is equal so far.
SHALLOW = 64


# Sorting -----------------------------------------------------------------------------------------


def _quicksort(words: np.ndarray):
    """Multikey quicksort of rows of 8-byte symbols: the order, and where in it a row differs from the one before.

    All open segments take a step together: each is split by the symbol of its middle row into the smaller, the
    equal and the larger; the equal go on with the next symbol, and close after the last.
    """
    n, depth = words.shape
    order, new = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, new
    new[0] = True
    first, last, at = np.array([0]), np.array([n]), np.array([0])
    while True:
        keep = (last - first > 1) & (at < depth)
        first, last, at = first[keep], last[keep], at[keep]
        if not len(first):
            return order, new
        size = last - first
        start = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(first)), size)
        place = np.arange(size.sum()) - start[segment] + first[segment]
        rows = order[place]
        symbol = words[rows, at[segment]]
        pivot = words[order[(first + last) >> 1], at][segment]
        side = np.where(symbol < pivot, 0, np.where(symbol == pivot, 1, 2))
        order[place] = rows[np.argsort(segment * 3 + side, kind="stable")]
        counts = np.bincount(segment * 3 + side, minlength=3 * len(first))
        ends = np.cumsum(counts)
        # Places count from the first open segment's start; each part lies within its own segment.
        shift = np.repeat(first - start, 3)
        begin, end = ends - counts + shift, ends + shift
        parts = counts > 0
        new[begin[parts]] = True
        first, last, at = begin[parts], end[parts], (np.repeat(at, 3) + np.tile([0, 1, 0], len(first)))[parts]


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - 1 - (((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() - 1) >> 3)


class BlindTrie:
    """A Patricia trie of strings: inner nodes keep a depth and the next bytes alone, so one comparison with one string places another."""

    def __init__(self) -> None:
        self.root: list | tuple | None = None  # (number, its string) lists at leaves, (depth, children) at inner nodes

    def add(self, number: int, text: bytes) -> None:
        if self.root is None:
            self.root = [text, number]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            node = children.get(text[depth] if len(text) > depth else -1) or next(iter(children.values()))
        other = node[0]
        if other == text:
            node.append(number)
            return
        common = _common(text, other)
        mine, own = text[common] if len(text) > common else -1, other[common] if len(other) > common else -1
        above, step, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < common:
            above, step = node, text[node[0]] if len(text) > node[0] else -1
            node = above[1][step]
        if isinstance(node, tuple) and node[0] == common:
            node[1][mine] = [text, number]
            return
        split = (common, {own: node, mine: [text, number]})
        if above is None:
            self.root = split
        else:
            above[1][step] = split

    def ordered(self) -> Iterator[tuple[int, int]]:
        """Each number in the order of its string, with the length that the string shares with the one before (-1 for the first)."""
        lcp, stack = -1, [(self.root, -1)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, tuple):
                depth, children = node
                steps = sorted(children)
                stack += [(children[c], depth if c != steps[0] else shared) for c in reversed(steps)]
            else:
                lcp = shared
                for number in node[1:]:
                    yield number, lcp
                    lcp = len(node[0])


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sort: the order of the strings, and how much each shares with the one before (0 for the first; equal strings: the whole length).

    Multikey quicksort to a depth of SHALLOW bytes, then a blind trie for each group of strings that are equal so far.
    """
    n, width = len(texts), SHALLOW
    block = np.frombuffer(b"".join([t[:width].ljust(width, b"\0") for t in texts]), np.uint8).reshape(n, width)
    order, new = _quicksort(block.view(">u8").astype(np.uint64))
    ordered = block[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differs = ordered[1:] != ordered[:-1]
        lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    bounds = np.r_[np.flatnonzero(new), n]
    for a, b in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist(), strict=True):
        trie = BlindTrie()
        for i in order[a:b].tolist():
            trie.add(i, texts[i])
        placed = list(trie.ordered())
        order[a:b] = [i for i, _ in placed]
        lcp[a + 1 : b] = [shared for _, shared in placed[1:]]
    size = np.array([len(t) for t in texts], np.int64)[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))  # zeros that fill up a short string are none of its bytes
    return order, lcp


# Sampling ----------------------------------------------------------------------------------------


class Sample:
    """Which suffixes stand for the strings of ``length`` bytes.

    Of the ``window`` places from a string's start on, the one with the least hash of the next ``gram``
    bytes (the first of equal ones) is its anchor.  It depends on the string alone, so equal
    strings have anchors at the same distance from their starts.
    """

    def __init__(self, length: int) -> None:
        self.length = length
        self.window = max(1, length * 5 // 8)
        self.gram = max(1, min(16, length - self.window + 1))
        self.right = length - self.window + 1  # bytes from an anchor on that all its strings hold

    def anchors(self, raw: np.ndarray, at: np.ndarray):
        """Anchors of all strings within the texts: place of each, first and last start of the strings that it stands for."""
        found, pos, block = [], 0, 1 << 21
        end_of = np.empty(0, np.int64)
        while pos < len(raw):
            stop = min(pos + block, len(raw))
            part = raw[pos : stop + self.length]
            text = np.searchsorted(at, np.arange(pos, stop), side="right")
            end_of = at[text]
            starts = np.flatnonzero(np.arange(pos, stop) + self.length <= end_of)
            if len(starts):
                found.append((self._least(part)[starts] + pos, starts + pos))
            pos = stop
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        anchor, start = (np.concatenate(x) for x in zip(*found, strict=True))
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        return anchor[new], start[new], start[np.r_[new[1:], len(start)] - 1]

    def _least(self, raw: np.ndarray) -> np.ndarray:
        """For each place with room for it, the place of the least gram among the window from there on."""
        value, reach = B.mix((raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), 1
        while reach < self.gram:  # doubling: hashes of 2 x reach bytes, the last overlapping
            step = min(reach, self.gram - reach)
            value = B.mix(value[:-step] * np.uint64(0xD6E8FEB86659FD93) + value[step:]) if len(value) > step else value[:0]
            reach += step
        n = len(value)
        if n < self.window:
            return np.empty(0, np.int64)
        low = np.uint64((1 << 24) - 1)
        packed = (value & ~low) | np.arange(n, dtype=np.uint64)
        w = self.window
        rows = -(-n // w)
        padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = packed
        grid = padded.reshape(rows, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)


def _sampled(length: int):
    """Rows of an anchor: hashes of its text (t1, t2) and place, of the bytes that all its strings hold (key), of its surroundings (h1, h2), and the offsets of its strings."""
    sample = Sample(length)
    left, right = sample.window - 1, length

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text"):
            raw, at = B.buffers(batch.column("text"))
            place, low, high = sample.anchors(raw, at)
            if not len(place):
                continue
            text = np.searchsorted(at, place, side="right") - 1
            a, b = np.maximum(at[text], place - left), np.minimum(at[text + 1], place + right)
            data = memoryview(np.ascontiguousarray(raw))
            key = [xxhash.xxh3_64_intdigest(data[p : p + sample.right]) for p in place.tolist()]
            # The length on the left is part of the name: where a text begins is part of the surroundings.
            around = b"".join([xxhash.xxh3_128_digest(data[x:y], seed=p - x) for x, y, p in zip(a.tolist(), b.tolist(), place.tolist(), strict=True)])
            names = np.frombuffer(around, np.int64).reshape(-1, 2)
            whole = np.frombuffer(b"".join([_text_name(data[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]), np.int64).reshape(-1, 2)[text]
            out = [np.array(key, np.uint64).view(np.int64), names[:, 0], names[:, 1], whole[:, 0], whole[:, 1], place - at[text], (place - high).astype(np.int32), (place - low).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in out], ["key", "h1", "h2", "t1", "t2", "place", "least", "most"])

    return run


def _text_name(data) -> bytes:
    return xxhash.xxh3_128_digest(data, seed=13)


def _named(batches: Iterator[pa.RecordBatch]):
    """Rows with the name of their text: rid, text, t1, t2."""
    for batch in B.portions(batches, "text"):
        raw, at = B.buffers(batch.column("text"))
        data = memoryview(np.ascontiguousarray(raw))
        names = np.frombuffer(b"".join([_text_name(data[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1]))], [*batch.schema.names, "t1", "t2"])


# Groups of suffixes ------------------------------------------------------------------------------

_PIECE = "key long, h1 long, h2 long, n long, hot boolean, least int, most int, before binary, suffix binary"


def _pieces(length: int):
    """Cut from each text the suffixes asked for, as far as their strings reach, and the bytes before them, last first."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text"):
            out: list[tuple] = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = text.encode()
                for w in wanted:
                    p = w["place"]
                    out.append((w["key"], w["h1"], w["h2"], w["n"], w["hot"], w["least"], w["most"], data[p - w["most"] : p][::-1], data[p : p - w["least"] + length]))
            if out:
                kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int32()] * 2 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _PIECE.split(", ")])

    return run


def repeated_offsets(length: int, n: np.ndarray, least: np.ndarray, most: np.ndarray, before: list[bytes], suffix: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes with what stands before them: the least and the greatest offset at which a string of ``length`` bytes that starts that far before the suffix is there more than once (-1: none).

    A string at an offset is the end of the one side and the beginning of the other; it equals another
    one if both sides are equal that deep, which the orders of both sides tell.
    """
    m = len(suffix)
    side = []
    for texts in (before, suffix):
        order, lcp = suffix_order(texts)
        side.append((order, lcp))
    low, high = np.full(m, -1), np.full(m, -1)

    def classes(which: int, depth: int) -> np.ndarray:
        order, lcp = side[which]
        out = np.empty(m, np.int64)
        out[order] = np.cumsum(lcp < depth)
        return out

    for o in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if not len(own):
            continue
        name = classes(0, o)[own] * (m + 1) + classes(1, length - o)[own]
        _, at = np.unique(name, return_inverse=True)
        hit = own[np.bincount(at, weights=n[own])[at] > 1]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


_FOUND = "key long, h1 long, h2 long, low int, high int"


def _sorted_groups(length: int, most_bytes: int = 1 << 23):
    """Sort the suffixes of whole keys (rows come by key), about ``most_bytes`` at a time."""

    def work(table: pa.Table):
        number = lambda c: table.column(c).to_numpy()
        low, high = repeated_offsets(length, number("n"), number("least"), number("most"), table.column("before").to_pylist(), table.column("suffix").to_pylist())
        hit = np.flatnonzero(low >= 0)
        if len(hit):
            taken = table.select(["key", "h1", "h2"]).take(pa.array(hit)).combine_chunks()
            yield from pa.table([*taken.columns, pa.array(low[hit].astype(np.int32)), pa.array(high[hit].astype(np.int32))], ["key", "h1", "h2", "low", "high"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]):
        held_back: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held_back.append(batch)
            size += batch.nbytes
            if size < most_bytes:
                continue
            table = pa.Table.from_batches(held_back)
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1], side="left"))  # the last key may go on in the next batch
            if whole:
                yield from work(table.slice(0, whole))
                table = table.slice(whole).combine_chunks()
            held_back, size = table.to_batches(), table.nbytes
        if held_back:
            yield from work(pa.Table.from_batches(held_back))

    return run


def _windows(length: int):
    """All strings of suffixes, each by two hashes: key, h1, h2, n, o (its offset), w1, w2."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                data, m = r["before"][::-1] + r["suffix"], r["most"]
                offsets = range(r["least"], m + 1)
                names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[m - o : m - o + length]) for o in offsets]), np.int64).reshape(-1, 2)
                k = len(offsets)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(k, r[c])) for c in ("key", "h1", "h2", "n")), pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1]))], ["key", "h1", "h2", "n", "o", "w1", "w2"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]):
    """Texts without the spans that are marked: n_bytes, n_removed, n_spans, kept."""
    for batch in B.portions(batches, "text"):
        out: list[tuple] = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, runs = text.encode(), []
            for s in sorted((x["a"], x["b"]) for x in spans or []):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            edges = [0, *(x for r in runs for x in r), len(data)]
            kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
            out.append((len(data), len(data) - len(kept), len(runs), kept))
        kinds = [pa.int64()] * 3 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _among(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose values ``on`` are in ``wanted``.

    These are written first: next to an aggregation Spark leaves all rows of a frequent value to one task, between two plain shuffles it splits them.
    """
    return rows.join(held(wanted), on, "left_semi")


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, most_group: int = 1 << 15) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts anywhere else, in the same or another text.

    1. Sampled suffixes: each string has an anchor among its first places, chosen by its bytes alone, so
       equal strings have anchors at equal distances.  All strings of an anchor hold the same bytes from it on; their hash is
       the key that suffixes meet by.  Anchors with equal surroundings are put together with a count, before
       any text is moved: a passage in a third of all texts is one class.
    2. Deep-shallow sorting: the classes of a key that is there more than once are sorted by the suffix, and
       by what stands before it read backwards: multikey quicksort to SHALLOW bytes, blind tries
       beyond.  A string is there twice if its two sides are equal deep enough in both orders; counts of classes count along.
    3. Spans go back to the texts by the class of their anchors.

    A key with more than ``most_group`` different classes (a passage after which or before which so many texts
    differ) would not fit into a task: its strings are counted one by one, by 128-bit hashes, over a shuffle
    that combines first.  Nothing is left out, and nothing grows in a task, in a broadcast or in the driver.  Names of
    texts and surroundings are 128-bit hashes.

    Null text is empty; texts under ``length`` bytes keep all; texts are named by their bytes, so rows that repeat
    (with equal, different or null ids) are other places, and equal texts lose the same; an empty table gives no rows; a
    very long text is sampled in blocks by one task; cuts may fall within a character, so what is kept are
    bytes; other columns are not looked at, whatever their names.
    Columns: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = texts.mapInArrow(_named, f"id {kind}, text string, t1 long, t2 long")
    name = ["key", "h1", "h2"]

    sampled = held(texts.select("text").mapInArrow(_sampled(length), "key long, h1 long, h2 long, t1 long, t2 long, place long, least int, most int"))
    at = F.min(F.struct("t1", "t2", "place", "least", "most")).alias("at")
    every = held(sampled.groupBy(*name).agg(F.count("*").alias("n"), at))  # equal surroundings are combined before they meet by key
    repeated = every.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    classes = held(_among(every, repeated, ["key"]))

    hot = held(classes.groupBy("key").count().where(F.col("count") > most_group).select("key", F.lit(True).alias("hot")))
    frequent = hot.count() > 0
    # Marked before the pieces are cut: a repartition by key right after a join by key is left out by Spark, and a split of the join's skewed tasks would part keys.
    classes = classes.join(hot, "key", "left") if frequent else classes.withColumn("hot", F.lit(None).cast("boolean"))
    wanted = classes.groupBy(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2")).agg(F.collect_list(F.struct(*name, "n", "hot", "at.place", "at.least", "at.most")).alias("wanted"))
    once = named.groupBy("t1", "t2").agg(F.any_value("text").alias("text"))
    pieces = held(once.join(wanted, ["t1", "t2"]).select("text", "wanted").mapInArrow(_pieces(length), _PIECE))

    found = pieces.where("hot IS NULL").repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(length), _FOUND)
    if frequent:
        strings = held(pieces.where("hot").mapInArrow(_windows(length), "key long, h1 long, h2 long, n long, o int, w1 long, w2 long"))
        twice = strings.groupBy("w1", "w2").agg(F.sum("n").alias("all")).where("all > 1").select("w1", "w2")
        found = found.union(_among(strings, twice, ["w1", "w2"]).groupBy(*name).agg(F.min("o").alias("low"), F.max("o").alias("high")))
    found = held(found)

    spans = sampled.join(found, name).select("t1", "t2", F.struct((F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + length).alias("b")).alias("span"))
    marked = held(spans.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans")))
    out = named.join(marked, ["t1", "t2"], "left").select("id", "text", "spans").mapInArrow(_removed, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
ORACLE_SQL = {
    "op13_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, b, substr(h, 400 * b + 1, 1200) AS h FROM (SELECT doc_id, h, unnest(range(strlen(h) // 400 + 1)) AS b FROM h)),
w AS (SELECT doc_id, 200 * b + i AS i, md5(substr(h, 2 * i + 1, 800)) AS k FROM b, (SELECT unnest(range(200)) AS i) WHERE strlen(h) >= 2 * i + 800),
hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
step AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM hit),
run AS (SELECT doc_id, i, count_if(gap IS NULL OR gap > 400) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM step),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY ALL),
edge AS (SELECT doc_id, r, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY r), 0) AS x, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY r) IS NULL AS last FROM span),
kept AS (SELECT h.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (a - x)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY r) AS k, sum(b - a) AS n_removed, count(*) AS n_spans FROM edge JOIN h ON h.doc_id = edge.doc_id GROUP BY 1)
SELECT h.doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM h LEFT JOIN kept ON kept.doc_id = h.doc_id
"""
}
