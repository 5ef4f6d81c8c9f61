"""Operator 10: byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import held


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str):
    """The encoder of a rank file, the bytes of every id, and the compiled pattern."""
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    token = [b""] * (1 + max(ranks.values(), default=-1))
    for of, rank in ranks.items():
        token[rank] = of
    return encoding, token, regex.compile(pattern)


def sync_points(pattern, text: str, more: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk that are sure and may start a piece; ``more``: text follows the chunk.

    Sure: if text follows, the match ends two characters before the end at least,
    so that no look-ahead saw the cut.  May start a piece: the character before is no
    white space, so that text up to there splits alike with or without what follows.
    """
    last = len(text) - 2 if more else len(text) - 1
    return [p for m in pattern.finditer(text) if (p := m.end()) <= last and not text[p - 1].isspace()]


def _chunks(size: int, overlap: int):
    """(h1, h2, k, start, end, text) of each chunk of a text, with ``overlap`` characters of the next one."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py()
                starts = range(0, len(text), size)
                for k, at in enumerate(starts):  # one at a time: a very long text is never held twice
                    name = [pa.array([batch.column(c)[row].as_py()], pa.int64()) for c in ("h1", "h2")]
                    yield pa.RecordBatch.from_arrays([*name, *(pa.array([x], pa.int32()) for x in (k, at, min(len(text), at + size))), pa.array([text[at : at + size + overlap]], pa.string())], ["h1", "h2", "k", "start", "end", "text"])

    return run


def _pretokenised(path: str, pattern: str):
    """Chunks with the sync points that the chunk before (head) and the chunk after (tail) may have too, as places in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]):
        splitter = _codec(path, pattern)[2]
        for batch in batches:
            heads, tails = [], []
            for text, start, end, n in zip(*(batch.column(c) for c in ("text", "start", "end", "overlap")), strict=True):
                value, at, stop, overlap = text.as_py(), start.as_py(), end.as_py(), n.as_py()
                points = [at + p for p in sync_points(splitter, value, at + len(value) > stop)]
                heads.append([p for p in points if p <= at + overlap])
                tails.append([p for p in points if p >= stop])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "k", "start", "end", "text")), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["h1", "h2", "k", "start", "end", "text", "head", "tail"])

    return run


def _encoded_pieces(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]):
        encoding, token, _ = _codec(path, pattern)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = encoding.encode_ordinary(batch.column("text")[row].as_py())
                own = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("h1", "h2", "piece")), pa.array([ids], pa.list_(pa.int32())), pa.array([b"".join([token[x] for x in ids])], pa.binary())], ["h1", "h2", "piece", "ids", "decoded"])

    return run


def encode_long(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Token ids and decoded bytes of long texts (h1, h2: a text's two hashes, text), each once: h1, h2, n_tokens, ids, decoded.

    Chunks with an overlap are dealt out over tasks and pre-tokenised by
    themselves.  Where a chunk and the next have a boundary in common (in the
    overlap), both split alike from there on, so it is a boundary of the whole
    text if the ones before were found too: there the chunks are stitched.  From the first
    chunk on that does not meet its successor (one pre-token longer than the overlap) the rest
    of the text is one piece.  Pieces are dealt out and encoded by themselves.
    """
    pieces = texts.select("h1", "h2", "text").mapInArrow(_chunks(chunk, overlap), "h1 long, h2 long, k int, start int, end int, text string")
    spread = pieces.dropDuplicates(["h1", "h2", "k"]).withColumn("overlap", F.lit(overlap))  # the exchange deals chunks out
    found = held(spread.mapInArrow(_pretokenised(path, pattern), "h1 long, h2 long, k int, start int, end int, text string, head array<int>, tail array<int>"))
    order = Window.partitionBy("h1", "h2").orderBy("k")
    follows = F.lead("k").over(order).isNotNull()
    common = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    met = found.select("h1", "h2", "k", "start", "end", common.alias("stitch"), follows.alias("follows"))
    lost = F.max((F.col("follows") & F.col("stitch").isNull()).cast("int"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    traced = met.withColumns({"lost": F.coalesce(lost.over(before), F.lit(0)), "lost_here": F.coalesce(lost.over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)), "last": F.lag("stitch").over(order)})
    bounds = traced.select(
        "h1", "h2", "k", F.when((F.col("lost") == 0) & (F.col("k") > 0), F.col("last")).otherwise(F.col("start")).alias("begin"),
        F.when((F.col("lost_here") == 0) & F.col("follows"), F.col("stitch")).otherwise(F.col("end")).alias("stop"), (F.sum(1 - F.col("lost")).over(order) - 1).cast("int").alias("piece"),
    )
    own = found.select("h1", "h2", "k", "start", "text").join(bounds.hint("merge"), ["h1", "h2", "k"])
    parts = own.select("h1", "h2", "piece", "k", F.col("text").substr(F.col("begin") - F.col("start") + 1, F.col("stop") - F.col("begin")).alias("text"))
    in_order = lambda at, c: F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda x: x[c])
    whole = parts.groupBy("h1", "h2", "piece").agg(F.array_join(in_order("k", "text"), "").alias("text"))
    coded = whole.mapInArrow(_encoded_pieces(path, pattern), "h1 long, h2 long, piece int, ids array<int>, decoded binary")
    joined = coded.groupBy("h1", "h2").agg(F.flatten(in_order("piece", "ids")).alias("ids"), in_order("piece", "decoded").alias("d"))
    return joined.select("h1", "h2", F.size("ids").cast("long").alias("n_tokens"), "ids", F.aggregate("d", F.lit(b""), lambda a, x: F.concat(a, x)).alias("decoded"))


def bpe_codec(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 32768, overlap_chars: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text by byte-level ranks and decode the ids again.

    Texts of up to ``chunk_chars`` are a map over Arrow batches without a shuffle:
    rows are independent, and a lost executor only repeats its own batches.  Longer ones
    are pre-tokenised in overlapping chunks in parallel tasks, stitched where their
    pre-token boundaries resynchronise, and encoded by piece (see ``encode_long``).
    Decoding concatenates the raw bytes of the ids.

    Null text is encoded as empty; each row gives a row, repeated rows and null ids
    too; an empty table gives no rows; of a very long text only the joined ids and
    bytes come together in one task; other columns are not looked at, whatever their
    names.  Columns: id, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the decoded bytes), and with ``keep_ids`` ids
    (array<int>) and decoded (binary).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk_chars

    def run(batches: Iterator[pa.RecordBatch]):
        encoding, token, _ = _codec(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes, all_ids, all_bytes = [], [], [], [], []
            for value in batch.column("text"):
                ids = encoding.encode_ordinary(value.as_py())
                decoded = b"".join([token[x] for x in ids])
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                    all_bytes.append(decoded)
            out = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            if keep_ids:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    short = rows.where(~is_long).mapInArrow(run, schema)
    named = rows.where(is_long).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    coded = encode_long(named, path, pattern, chunk_chars, overlap_chars)
    digests = coded.select("h1", "h2", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids", "decoded"] if keep_ids else []))
    long = named.select("id", "h1", "h2").join(digests.hint("merge"), ["h1", "h2"])
    return short.unionByName(long.select(*names)).withColumnRenamed("id", id_col)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codec(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
