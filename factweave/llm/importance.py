"""Operator 3: quality classifier by importance resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesets as B
from .components import held

#: Buckets of the hashed n-gram models.
BUCKETS = 1 << 14


def _features(batch: pa.RecordBatch):
    """Bucket of every word and every word pair, and the row each belongs to."""
    raw, at = B.buffers(batch.column("text"))
    *_, hashes, first = B.words(raw, at, B.NONSPACE)
    row = B.owner(first)
    pairs = B.grams(hashes, 2)
    inside = row[:-1] == row[1:] if len(row) > 1 else np.empty(0, bool)
    shift = np.uint64(64 - 14)
    buckets = np.concatenate([B.mix(hashes) >> shift, pairs[inside] >> shift]).astype(np.int64)
    return buckets, np.concatenate([row, row[:-1][inside] if len(row) > 1 else row[:0]])


def _count(batches: Iterator[pa.RecordBatch]):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in B.portions(batches, "text"):
        buckets, row = _features(batch)
        raw += np.bincount(buckets, minlength=BUCKETS)
        wanted = np.array(batch.column("wanted").to_pylist(), dtype=bool)
        target += np.bincount(buckets[wanted[row]], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])


def bounded_ids(ids: DataFrame, most: int) -> DataFrame:
    """All ids, or those whose hash falls in the first buckets that hold ``most`` at the most."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(4096))
    ids = ids.where("id IS NOT NULL").distinct()
    total, last = 0, -1
    for r in sorted(ids.groupBy(bucket.alias("bucket")).count().collect()):
        if total + r["count"] > most:
            break
        total, last = total + r["count"], r.bucket
    else:
        return ids
    return ids.where(bucket <= last)


def _kth(scored: DataFrame, k: int):
    """The k rows with the largest sample_key (then smallest id): a condition, and the rows of the bin at the edge that belong to them."""
    low, high = scored.agg(F.min("sample_key"), F.max("sample_key")).first()
    above, bins = 0, 4096
    for _ in range(8):
        if low is None or low == high:
            break
        width = (high - low) / bins
        inside = scored.where((F.col("sample_key") >= low) & (F.col("sample_key") <= high))
        counts = {r.bin: r["count"] for r in inside.groupBy(F.least(F.floor((F.col("sample_key") - low) / width), F.lit(bins - 1)).alias("bin")).count().collect()}
        edge, passed = -1, above
        for b in sorted(counts, reverse=True):
            if passed + counts[b] >= k:
                edge = b
                break
            passed += counts[b]
        if edge < 0 or width == 0:
            break
        found = inside.where(F.least(F.floor((F.col("sample_key") - low) / width), F.lit(bins - 1)) == edge).agg(F.min("sample_key"), F.max("sample_key")).first()
        low, high, above = found[0], found[1], passed
        if counts[edge] <= 10_000:
            break
    return low, high, above


def importance_resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: str = "quality = 1 AND toxic = 0", max_target: int = 20_000, fraction: float | None = None, seed: int = 11, smoothing: float = 1.0) -> DataFrame:
    """Draw documents as if from the target: hashed n-gram models and Gumbel top-k.

    Two bag-of-n-grams models over hashed words and word pairs: of the documents
    whose labels fulfil ``target`` (at most ``max_target`` of them, chosen by the
    hash of their id), and of all documents.  The weight of a document is the
    log-ratio of its likelihood under both.  Adding Gumbel noise, drawn from the
    id and ``seed``, and taking the k largest sums samples k documents without
    replacement in proportion to the weights; k is ``fraction`` of all documents,
    by default the share of labelled documents that fulfil ``target``.  Counts
    cover all documents; the models have a fixed number of buckets.  The k-th sum
    is found by counting bins, never by sorting all rows in one task.

    Null and empty texts have no n-grams and weight 0; without labels all weights
    are 0 and k is 0; a label with a null id marks no document, a null label does not
    fulfil the target, and of several labels of an id one has to; repeated rows are
    judged alike, so that more than k rows are selected where the last id repeats; ties go
    to the smaller id, null first; an empty table gives no rows; a very long text is
    worked off in blocks by one task; other columns are not looked at, whatever their
    names.  Columns: id, n_grams, log_weight, sample_key, selected.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce(F.expr(target), F.lit(False))).alias("good"))
    labelled = marks.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    wanted = bounded_ids(marks.where("good").select("id"), max_target).withColumn("wanted", F.lit(True))
    marked = texts.join(F.broadcast(wanted), "id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    counts = marked.select("text", "wanted").mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()

    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts.column("bucket").to_numpy()] = counts.column("raw").to_numpy()
    good[counts.column("bucket").to_numpy()] = counts.column("target").to_numpy()
    ratio = np.log((good + smoothing) / (good.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS)) if good.any() else np.zeros(BUCKETS)
    model = texts.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]):
        for batch in B.portions(batches, "text"):
            buckets, row = _features(batch)
            n = batch.num_rows
            weight = np.bincount(row, weights=model.value[buckets], minlength=n).astype(np.float64)  # without words numpy counts in integers
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(weight)], ["id", "n_grams", "log_weight"])

    scored = texts.mapInArrow(score, f"id {texts.schema['id'].dataType.simpleString()}, n_grams long, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = held(scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))))
    total = scored.count()
    k = round(total * (fraction if fraction is not None else labelled.good / labelled.n if labelled.n else 0.0))
    if not 0 < k < total:
        return scored.select(F.col("id").alias(id_col), "n_grams", "log_weight", "sample_key", F.lit(k > 0).alias("selected"))
    low, high, above = _kth(scored, k)
    # Rows of one id and key count together, so however often an id repeats, the edge has a row for it.
    edge = scored.where((F.col("sample_key") >= low) & (F.col("sample_key") <= high)).groupBy("sample_key", "id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("sample_key"), F.asc("id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = edge.withColumn("before", before).where(F.col("before") < k - above).orderBy("sample_key", F.desc("id")).first()
    tie = (F.col("sample_key") == last.sample_key) & (F.col("id").isNull() if last.id is None else F.col("id").isNull() | (F.col("id") <= F.lit(last.id)))
    return scored.select(F.col("id").alias(id_col), "n_grams", "log_weight", "sample_key", ((F.col("sample_key") > last.sample_key) | tie).alias("selected"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_importance_resampling": op3_importance_resampling}
ORACLE_SQL: dict[str, str] = {}
