"""Operator 2: benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets as B
from .components import bit_table, held

#: Slots of the bit table that thins out document shingles before the join; its size does not depend on the data.
SLOTS = 1 << 21
_SHIFT = np.uint64(64 - 21)


def _lowered_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> str:
    data = B.LOWER[raw[starts[a] : ends[b - 1]]].tobytes()
    base = starts[a]
    return b" ".join(data[s - base : e - base] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)).decode()


def _window_shingles(window: int, shingle: int):
    """Item texts to (item_id, window words, window length, offset of the shingle, shingle length, key)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text"):
            raw, at = B.buffers(batch.column("text"))
            starts, ends, hashes, first = B.words(raw, at, B.ALNUM)
            out: list[tuple] = []
            for row, item in enumerate(batch.column("item_id").to_pylist()):
                a, b = int(first[row]), int(first[row + 1])
                w = min(window, b - a)
                if not w:
                    continue
                k = min(shingle, w)
                keys = B.signed(B.grams(hashes[a:b], k)).tolist()
                for i in range(b - a - w + 1):
                    text = _lowered_words(raw, starts, ends, a + i, a + i + w)
                    out += [(item, text, w, o, k, keys[i + o]) for o in range(w - k + 1)]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field("item_id").type), pa.array(columns[1], pa.string()), *(pa.array(c, pa.int32()) for c in columns[2:5]), pa.array(columns[5], pa.int64())],
                    ["item_id", "window", "w", "o", "k", "key"],
                )

    return run


def _slots(keys: DataFrame) -> np.ndarray:
    """The bit table of the keys: SLOTS booleans, however many keys there are."""
    return bit_table(keys.select(F.shiftrightunsigned("key", 43).alias("slot")), SLOTS)


def _document_shingles(batch: pa.RecordBatch, sizes: list[int], table: np.ndarray):
    """Words of the batch and, for each shingle length, the places whose key is in the table."""
    raw, at = B.buffers(batch.column("text"))
    starts, ends, hashes, first = B.words(raw, at, B.ALNUM)
    text_of = B.owner(first)
    found = []
    for k in sizes:
        keys = B.grams(hashes, k)
        places = np.flatnonzero(table[(keys >> _SHIFT).astype(np.int64)]) if len(keys) else np.empty(0, np.int64)
        places = places[text_of[places] == text_of[places + k - 1]]
        found.append((k, places, keys[places]))
    return raw, starts, ends, first, text_of, found


def _count_shingles(sizes: list[int], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text"):
            *_, found = _document_shingles(batch, sizes, table)
            keys, counts = np.unique(np.concatenate([x[2] for x in found]), return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(keys)), pa.array(counts.astype(np.int64))], ["key", "n"])

    return run


def _candidates(sizes: list[int], table: np.ndarray, window: int):
    """One row for each place of a prefix shingle, with the words around it, and one with place -1 for each document."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text"):
            raw, starts, ends, first, text_of, found = _document_shingles(batch, sizes, table)
            n = batch.num_rows
            n_words = np.diff(first)
            rows, pos, keys, lead, context = [np.arange(n)], [np.full(n, -1)], [np.zeros(n, np.int64)], [np.zeros(n, np.int64)], [""] * n
            for k, places, found_keys in found:
                doc = text_of[places]
                low = np.maximum(first[doc], places - (window - k))
                high = np.minimum(first[doc + 1], places + window)
                rows.append(doc)
                pos.append(places - first[doc])
                keys.append(B.signed(found_keys))
                lead.append(places - low)
                context += [_lowered_words(raw, starts, ends, a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(n_words[rows].astype(np.int64)), pa.array(np.concatenate(pos).astype(np.int64)), pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(lead).astype(np.int32)), pa.array(context, pa.string())],
                ["id", "n_words", "pos", "key", "lead", "context"],
            )

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 3, salts: int = 16) -> DataFrame:
    """Which words of each document lie inside a benchmark window, and of which items.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter item.  Windows and documents are sets of word shingles.  Shingles
    are ordered by how often they occur in all documents; a document holds a
    window only if it holds the window's rarest shingle (its necessary prefix:
    containment allows no miss), so documents and windows meet on that key
    alone, salted against passages that many documents share.  A pair goes on if
    the window fits between the document's first and last word at that place,
    and counts if the words are equal.  Only a bit table of fixed size goes to
    the workers; it thins out the shingles and decides nothing.

    Null text has no words; an item without words has no window; equal item
    texts all count, and a null item id is left out of the items; rows that repeat a
    document id become one row (its places and items together, the larger word count),
    and so do all rows with a null id; empty tables give no rows, or documents
    without hits; a very long text is one row of a batch of its own, its words
    worked off in blocks.  Other columns are not looked at, whatever their names.  Columns: id,
    n_words, n_hit, n_items, items_sha256, contaminated, items (sorted array of
    strings), spans (sorted array of [start, end) word places).
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    item_type, id_type = wanted.schema["item_id"].dataType.simpleString(), texts.schema["id"].dataType.simpleString()
    shingles = wanted.mapInArrow(_window_shingles(window, shingle), f"item_id {item_type}, window string, w int, o int, k int, key long")
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect()) or [shingle]

    table = texts.sparkSession.sparkContext.broadcast(_slots(shingles))
    seen = texts.mapInArrow(lambda batches: _count_shingles(sizes, table.value)(batches), "key long, n long").groupBy("key").agg(F.sum("n").alias("df"))
    prefix = (
        shingles.drop("item_id").distinct().join(seen, "key", "left")
        .groupBy("window", "w")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key", "o")).alias("p"))
        .where("p.df > 0")
        .select("window", "w", "p.key", "p.o")
    )
    owners = shingles.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("holders"))
    prefix = held(prefix.join(owners, "window"))  # small: one row for each window; it serves the bit table and the join

    rare = texts.sparkSession.sparkContext.broadcast(_slots(prefix))
    places = texts.mapInArrow(lambda batches: _candidates(sizes, rare.value, window)(batches), f"id {id_type}, n_words long, pos long, key long, lead int, context string")
    salt = F.pmod(F.xxhash64("id", "pos"), F.lit(salts)).cast("int")
    left = places.withColumn("salt", salt).withColumn("key", F.when(F.col("pos") < 0, F.xxhash64("id")).otherwise(F.col("key")))
    right = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    start = F.col("pos") - F.col("o")
    fits = (F.col("pos") >= 0) & (start >= 0) & (start + F.col("w") <= F.col("n_words")) & (F.col("lead") >= F.col("o"))
    equal = F.array_join(F.slice(F.split("context", " "), F.greatest(F.col("lead") - F.col("o"), F.lit(0)) + 1, F.col("w")), " ") == F.col("window")
    joined = left.join(right, ["key", "salt"], "left").withColumn("hit", F.coalesce(fits & equal, F.lit(False)))
    span = F.struct(start.cast("int").alias("start"), (start + F.col("w")).cast("int").alias("end"))
    grouped = joined.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("hit"), span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("holders")))))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
    )["n"]
    return grouped.select(
        F.col("id").alias(id_col), "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items", "spans",
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.drop("items", "spans")


_WORDS = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM documents),
i AS (SELECT item_id, coalesce({_WORDS.format(t="text")}, []) AS ws FROM benchmark),
iw AS (SELECT item_id, ws, least(10, len(ws)) AS w, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, w, array_to_string(ws[p : p + w - 1], ' ') AS window FROM iw),
sizes AS (SELECT DISTINCT w FROM win),
dw AS (SELECT doc_id, s.w, unnest(range(1, len(ws) - s.w + 2)) AS p, ws FROM d, sizes s WHERE len(ws) >= s.w),
hits AS (SELECT dw.doc_id, dw.p, dw.w, win.item_id FROM dw JOIN win ON dw.w = win.w AND array_to_string(dw.ws[dw.p : dw.p + dw.w - 1], ' ') = win.window),
places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + w)) AS q FROM hits) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN held USING (doc_id)
"""
}
