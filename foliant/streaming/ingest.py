"""Incremental ingestion: new files only, chunked and added to a store, with content seen before left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.text import chunk_fixed


def incremental_ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Reads the Parquet files that arrived since the last run, drops repeated contents, appends chunks, and stops.

    Every batch is written under its own number, so a batch that runs again after a failure replaces itself. Contents
    are remembered for the watermark's two days.
    """
    stream = spark.readStream.schema(schema).parquet(source).withColumn("seen_at", F.current_timestamp()).withColumn("content_hash", F.sha2("text", 256))
    fresh = stream.withWatermark("seen_at", "2 days").dropDuplicatesWithinWatermark(["content_hash"])

    def add(batch: DataFrame, number: int) -> None:
        chunk_fixed(batch.select(key, "content_hash", "text"), key).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def ingest_and_read(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "doc_id") -> DataFrame:
    """Runs the ingestion to its end and returns the store."""
    incremental_ingest(spark, source, schema, target, checkpoint, key).awaitTermination()
    return spark.read.parquet(target)
