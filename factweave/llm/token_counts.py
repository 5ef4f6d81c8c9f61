"""Operator 1: token counts of whole texts."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a byte-level pre-token always ends: text turns to white space, or letters or digits end.
_BLANK = regex.compile(r"(?<=\S)(?=[ \t\n\r])")
_TURN = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


@lru_cache(maxsize=4)
def _counter(path: str, kind: str):
    """The numbers of tokens of a list of texts, and the strings of the added tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], ()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return lambda texts: [len(x.ids) for x in encode(texts, add_special_tokens=False)], added


def _cut(text: str, at: int, size: int, added: tuple[str, ...]) -> int:
    """The first safe place from ``at`` on: white space if some comes soon, else the end of a run of letters or digits that lies in no added token."""
    soon = _BLANK.search(text, at, min(len(text), at + size))
    if soon:
        return soon.start()
    for m in _TURN.finditer(text, at):
        p = m.start()
        if not any(text.find(t, max(0, p - len(t) + 1), p + len(t) - 1) >= 0 for t in added):
            return p
    return len(text)


def safe_pieces(text: str, size: int, added: tuple[str, ...] = ()) -> list[str]:
    """Cut a text every ``size`` characters or later, at safe boundaries.

    A byte-level pre-token never goes on from a non-space character to white
    space, nor from a letter or digit to another kind of character, and no added
    token (``added``) is cut, so counts add up.  A text that is one long word has
    no safe boundary: no encoder may split it, so it is one piece.
    """
    pieces, start, n = [], 0, len(text)
    while n - start > size:
        cut = _cut(text, start + size, size, added)
        pieces.append(text[start:cut])
        start = cut
    pieces.append(text[start:])
    return pieces


def token_counts(docs: DataFrame, path: str, *, kind: str = "tokenizers", id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, piece_chars: int = 16384, batch_bytes: int = 1 << 20) -> DataFrame:
    """Number of tokens of each text by the tokenizer file at ``path`` (on every executor).

    A map over Arrow batches without a shuffle: long texts are cut at safe
    boundaries (byte-level tokenizers only; sentencepiece texts stay whole),
    pieces are put into batches of about ``batch_bytes`` UTF-8 bytes, over the
    bounds of Arrow batches too, and encoded together; only lengths leave the worker.

    Null text counts as empty (0 bytes, 0 tokens); each row gives a row,
    repeated rows and null ids too; an empty table gives no rows; other columns of
    ``docs`` are not looked at, whatever their names.  Columns: id, n_bytes, n_tokens,
    over_limit (n_tokens > ``limit``).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches):
        counter, added = _counter(path, kind)
        waiting: list[tuple] = []  # Arrow batches whose pieces are all collected, but not all encoded
        pieces: list[str] = []
        owners: list[tuple[list[int], int]] = []
        size = 0

        def encode():
            for (totals, row), n in zip(owners, counter(pieces), strict=True):
                totals[row] += n
            pieces.clear()
            owners.clear()

        def ready():
            for batch, totals in waiting:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(totals, pa.int64()), batch.column("n_bytes")], ["id", "n_tokens", "n_bytes"])
            waiting.clear()

        for batch in batches:
            totals = [0] * batch.num_rows
            for row, value in enumerate(batch.column("text")):
                text = value.as_py()
                for piece in safe_pieces(text, piece_chars, added) if kind == "tokenizers" and len(text) > piece_chars else (text,):
                    pieces.append(piece)
                    owners.append((totals, row))
                    size += len(piece.encode()) + 16  # empty texts take room too
                    if size >= batch_bytes:
                        encode()
                        yield from ready()
                        size = 0
            waiting.append((batch.select(["id", "n_bytes"]), totals))
        encode()
        yield from ready()

    kind_of_id = rows.schema["id"].dataType.simpleString()
    counted = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(count, f"id {kind_of_id}, n_tokens long, n_bytes long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
