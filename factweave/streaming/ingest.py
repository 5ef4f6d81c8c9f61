"""Incremental ingest as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each type in tumbling windows; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def new_documents(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents of a stream without those whose content came within the watermark before."""
    return documents.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])
