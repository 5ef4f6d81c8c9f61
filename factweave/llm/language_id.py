"""Operator 9: language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets as B

#: Buckets of the hashed byte trigrams; as many again hold whole words.
BUCKETS = 1 << 15
#: a-z (after lower-casing) and every byte of a non-ASCII character.
LETTERS = np.array([97 <= b <= 122 or b >= 128 for b in B.LOWER.tolist()])


def _grams(batch: pa.RecordBatch):
    """Trigram bucket of each letter with its neighbours, the first of each word, the bucket of each word, and the first word of each row."""
    raw, at = B.buffers(batch.column("text"))
    starts, ends, hashes, first = B.words(raw, at, LETTERS)
    low = B.LOWER[raw]
    inside = LETTERS[low]
    x = np.where(inside, low, 32).astype(np.uint32)
    left, right = np.empty_like(x), np.empty_like(x)
    if len(x):
        left[0], left[1:] = 32, x[:-1]
        right[-1], right[:-1] = 32, x[1:]
        left[starts], right[ends - 1] = 32, 32
    code = ((left << np.uint32(16)) | (x << np.uint32(8)) | right)[inside] * np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    length = ends - starts
    return (code >> np.uint32(17)).astype(np.int64), np.cumsum(length) - length, (B.mix(hashes) >> np.uint64(49)).astype(np.int64) + BUCKETS, first


def _train(batches: Iterator[pa.RecordBatch]):
    counts: dict[str, np.ndarray] = {}
    for batch in B.portions(batches, "text"):
        code, begin, word, first = _grams(batch)
        letters = np.append(begin, len(code))[first]
        for row, lang in enumerate(batch.column("lang").to_pylist()):
            mine = counts.setdefault(lang, np.zeros(2 * BUCKETS, np.int64))
            for part in (code[letters[row] : letters[row + 1]], word[first[row] : first[row + 1]]):
                used, n = np.unique(part, return_counts=True)
                mine[used] += n
    for lang, mine in counts.items():
        used = np.flatnonzero(mine)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(mine[used])], ["lang", "bucket", "n"])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Language values and the log-probability of each bucket (buckets x languages).

    Counts cover all given rows with a language and are added up in Spark; what
    reaches the driver has a fixed number of buckets for each language.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    table = rows.mapInArrow(_train, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((2 * BUCKETS, len(names)))
    if names:
        place = np.searchsorted(np.array(names, dtype=object), np.array(table.column("lang").to_pylist(), dtype=object))
        counts[table.column("bucket").to_numpy(), place] = table.column("n").to_numpy()
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        part = counts[half] + smoothing
        counts[half] = np.log(part / part.sum(axis=0))
    return names, counts.astype(np.float32)


def _fit(like: np.ndarray, first: np.ndarray, share: np.ndarray, turns: int):
    """Expectation-maximisation of each row's proportions; also the log of each word's mixture likelihood."""
    row = B.owner(first)
    n = np.maximum(np.diff(first), 1)[:, None]
    full = np.flatnonzero(np.diff(first))
    for _ in range(turns):
        part = like * share[row]
        part /= part.sum(axis=1, keepdims=True) + 1e-30
        share = np.zeros_like(share)
        if len(full):
            share[full] = np.add.reduceat(part, first[full], axis=0)
        share /= n
    return share, np.log((like * share[row]).sum(axis=1) + 1e-30)


def infer(logs: np.ndarray, first: np.ndarray, *, turns: int = 6, penalty: float = 2.0):
    """For each row: proportions over all languages, and over the chosen set (0 outside).

    ``logs``: log-likelihood of each word in each language.  The sets tried are
    the 1, 2, ... languages with the largest proportions, up to all of them; each is
    fitted by itself, and the log-likelihood counts less ``penalty`` times the log of
    the number of words for each further language.  A row's search ends at the
    first set that is no better than the one before.
    """
    rows, languages = len(first) - 1, logs.shape[1]
    top = logs.max(axis=1, keepdims=True) if len(logs) else logs[:, :1]
    like = np.exp(np.maximum(logs - top, -60))
    share, _ = _fit(like, first, np.full((rows, languages), 1 / max(1, languages), np.float32), turns)
    order = np.argsort(-share, axis=1, kind="stable")
    sizes, best, chosen = np.diff(first), np.full(rows, -np.inf), share.copy()
    active = np.arange(rows)
    for k in range(1, languages + 1):
        if not len(active):
            break
        n = sizes[active]
        words = like if len(active) == rows else like[np.repeat(first[active] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        start = np.zeros((len(active), languages), share.dtype)
        np.put_along_axis(start, order[active, :k], np.float32(1 / k), axis=1)
        begin = np.concatenate([[0], np.cumsum(n)])
        fitted, word = _fit(words, begin, start, turns if k > 1 else 1)
        value = np.bincount(B.owner(begin), weights=word, minlength=len(active)) - penalty * (k - 1) * np.log(n + 1.0)
        better = value > best[active]
        active = active[better]
        best[active], chosen[active] = value[better], fitted[better]
    return share, chosen


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: an ASCII one, or else any by Unicode."""
    low = B.LOWER[raw]
    ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode()))
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language and mixture of each text; ``keep``: columns handed on as they are.

    Each word is a unit with the likelihood of its trigrams and of itself in
    each language.  Expectation-maximisation finds each document's proportions;
    the set of languages is chosen by penalised likelihood (see ``infer``).  The
    answer is the language with the largest share in the set, its score its
    share in the full mixture.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing was learned; repeated rows are judged alike; ties go to the
    first language in order; an empty table gives no rows; a very long text is
    judged whole, by itself in a batch; null and repeated ids are handed on; other
    columns are not looked at, whatever their names.  Columns: id,
    lang_pred, score, languages (name:share of the set, largest first).
    """
    names = model[0]
    held_model = docs.sparkSession.sparkContext.broadcast(model[1])
    # The text goes to the workers once, even if it is handed on.
    others = [c for c in keep if c != text_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_keep_{c}") for c in others))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text", 1 << 19):
            raw, at = B.buffers(batch.column("text"))
            known = has_letter(raw, at)
            langs, scores, sets = ["und"] * batch.num_rows, np.zeros(batch.num_rows), [""] * batch.num_rows
            if names:
                code, begin, word, first = _grams(batch)
                table = held_model.value
                logs = table[word]
                if len(begin):
                    logs = logs + np.add.reduceat(table[code], begin, axis=0)
                share, chosen = infer(logs, first)
                best = chosen.argmax(axis=1)
                ranked = np.argsort(-chosen, axis=1, kind="stable")
                for i in np.flatnonzero(known & (np.diff(first) > 0)):
                    langs[i], scores[i] = names[best[i]], min(1.0, max(0.0, float(share[i, best[i]])))
                    sets[i] = ",".join(f"{names[j]}:{chosen[i, j]:.3f}" for j in ranked[i] if chosen[i, j] > 0)
            kept = [batch.column("text")] if text_col in keep else []
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(sets, pa.string()), *kept, *(batch.column(f"_keep_{c}") for c in others)], given)

    kinds = dict(rows.dtypes)
    handed = [text_col, *others] if text_col in keep else others
    given = ["_id", "lang_pred", "score", "languages", *(f"_keep_{c}" for c in handed)]
    schema = ", ".join([f"_id {kinds['_id']}", "lang_pred string", "score double", "languages string", *(f"`_keep_{c}` {kinds.get(f'_keep_{c}', 'string')}" for c in handed)])
    return rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), "lang_pred", "score", "languages", *(F.col(f"_keep_{c}").alias(f"kept_{c}") for c in keep))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", held_out())


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
