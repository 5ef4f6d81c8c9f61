"""Connected components of an edge table, for the operators that link rows."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one of spark.checkpoint.dir.  Only a session in one process (local
    mode, as in tests) may go without: it gets a temporary one.  On a cluster a
    folder of one machine would be read in vain by the others, so that raises.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Lets a finished query drop its shuffle files at once instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def held(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: lost executors lose none of it, later steps read it
    instead of working it out anew, and the shuffle files behind it can go.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/held-{uuid4().hex}", spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bit_table(slots: DataFrame, size: int) -> np.ndarray:
    """Which of ``size`` slots stand in column slot: bits are put together in Spark, and size / 32768 rows of 4 kB at most come to the driver."""
    table, at = np.zeros(size, bool), F.col("slot").cast("long") + 1
    bits = slots.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    for r in bits.collect():
        own = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        start = (r.bucket - 1) * len(own)
        table[start : start + len(own)] = own[: size - start]
    return table


#: Edges whose moves are broadcast instead of shuffled.
SMALL = 10_000


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """Label each node that has an edge with the smallest node it is connected to.

    Rounds of contraction: each node moves to the neighbour (or itself) that
    comes first in a pseudo-random order of the round, edges move along, and
    edges inside one node go.  A constant share of the nodes goes away in each
    round in expectation, for chains and stars alike.  Minima are combined
    before the shuffle, so a hub with a third of all edges is no hot key of the
    aggregation, and the joins are plain equi-joins that adaptive execution can
    split.  Nothing is collected; each round ends in a table in the shared folder.
    The edges left are counted in each round: the moves of up to ``SMALL`` of them are
    broadcast (two rows an edge at most), those of more are merged.

    Columns: node, component.  Null ends and loops are no edges; repeated edges
    count once; an empty table gives no rows.
    """
    left = held(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    mapping = None
    for turn in range(100):
        n = left.count()
        if not n:
            break
        way = "broadcast" if n <= SMALL else "merge"
        both = left.union(left.select("b", "a"))
        order = lambda c, turn=turn: F.xxhash64(F.lit(turn), c)
        nearest = both.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("h"), F.col("b").alias("v"))).alias("m"))
        step = held(nearest.select(F.col("a").alias("node"), F.when(F.col("m.h") < order(F.col("a")), F.col("m.v")).otherwise(F.col("a")).alias("to")))
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")).hint(way), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")).hint(way), "b")
        left = held(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if mapping is None:
            mapping = step
        else:
            mapping = held(mapping.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")).hint(way), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
    else:
        raise RuntimeError("the contraction did not end")
    if mapping is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = mapping.groupBy("to").agg(F.min("node").alias("component"))
    return mapping.join(least.hint("merge"), "to").select("node", "component")
