"""Streams of documents: contents that came before within the watermark are dropped."""

from datetime import datetime

from factweave.streaming import ingest


def test_new_documents(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1, h)
    schema = "doc_id long, content_hash string, ts timestamp"
    spark.createDataFrame([(1, "a", at(1)), (2, "a", at(2)), (3, "b", at(3))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([(4, "b", at(4)), (5, "c", at(5))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.new_documents(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("fresh").collect()
    assert sorted(r.content_hash for r in got) == ["a", "b", "c"]
