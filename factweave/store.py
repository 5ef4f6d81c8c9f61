"""Tables kept as Parquet in the folder that driver and executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session in one process without it gets a temporary one, a cluster raises."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def kept(df: DataFrame, *by: str) -> DataFrame:
    """Write a table, in folders by the given columns, and read it again: later steps do not work it out anew, and plans stay small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
