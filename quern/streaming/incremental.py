"""Incremental work: appends that can be run again, and a stream of events beyond the batch operators.

Batches land by foreachBatch with an anti-join on what is stored, so that a batch given twice adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import file_system


#: Folders of a table that batches are appended to, by a hash of the key.
FOLDERS = 64


def append_new(spark: SparkSession, batch: DataFrame, path: str, key: str) -> None:
    """Appends the rows of a batch whose key the table at path lacks.

    The table lies in folders by a hash of the key, `_folder`, so that a batch is held against the keys of its own folders alone.
    """
    batch = batch.withColumn("_folder", F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int"))
    fs, at = file_system(spark, path)
    if fs.exists(at):
        own = [r[0] for r in batch.select("_folder").distinct().collect()]  # FOLDERS numbers at most
        stored = spark.read.parquet(path).where(F.col("_folder").isin(own)).select(key, "_folder")
        batch = batch.join(stored, [key, "_folder"], "left_anti")
    batch.write.mode("append").partitionBy("_folder").parquet(path)


def ingest(source: DataFrame, path: str, key: str, checkpoint: str):
    """A streaming query that appends new keys of a source to a table, available data at once."""

    def each(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch.dropDuplicates([key]), path, key)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rewards(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Purchases among events in tumbling windows; works on a stream (with the watermark) and on a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", size).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")
    ).select(F.col("w.start").alias("window_start"), "events", "purchases")
