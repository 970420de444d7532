"""The event log as a stream: append with deduplication, and a current table kept by key.

Both run as micro-batches whose progress lies in the checkpoint folder; a batch that is run again overwrites its own files, so a replay
after a restart gives the rows of one clean run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, schema, at: str, keys: list[str], late: str = "35 days", files_per_batch: int = 16) -> DataFrame:
    """New files of a folder as a stream; a key is passed on once within the watermark."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_log(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Write what is there to the log and return."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def window_counts(stream: DataFrame, at: str, kind: str, width: str = "7 days") -> DataFrame:
    """Tumbling counts per kind; weeks start on Monday, as the epoch is a Thursday."""
    return stream.groupBy(F.window(at, width, startTime="4 days").alias("w"), kind).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("week"), kind, "n")
