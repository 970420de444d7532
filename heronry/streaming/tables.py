"""Tables that a stream keeps: the append log with conflicts, the current row of each key, and state that lives as long as it is needed.

Results depend on (at, id) of the rows alone, never on the order in which they arrive, and a batch that runs again changes nothing: the
log is kept by content and the current table by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _content(columns: list[str]):
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def append_checked(stream: DataFrame, target: str, key: str, checkpoint: str) -> None:
    """New rows go to target/log; a known key with other content goes to target/conflicts, with equal content nowhere.

    Within one batch the first row by content stands for its key, so the outcome doesn't follow arrival.
    """
    columns = stream.columns

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns, _content(columns).alias("content")).dropDuplicates([key, "content"])
        firsts = rows.groupBy(key).agg(F.min("content").alias("first"))
        stored = spark.read.parquet(f"{target}/log") if _exists(spark, f"{target}/log") else None
        if stored is not None:
            stored = stored.filter(F.col("batch") < number).select(key, F.col("content").alias("stored"))
            firsts = firsts.join(stored, key, "left").withColumn("first", F.coalesce("stored", "first"))
        else:
            firsts = firsts.withColumn("stored", F.lit(None).cast("string"))
        told = rows.join(firsts, key)
        told.filter("stored IS NULL AND content = first").drop("first", "stored").write.mode("overwrite").parquet(f"{target}/log/batch={number}")
        told.filter("content <> first").drop("first", "stored").write.mode("overwrite").parquet(f"{target}/conflicts/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_part(spark: SparkSession, target: str, part: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{target}/{part}").select(*columns)


def keep_current(stream: DataFrame, target: str, key: str, order: list[str], checkpoint: str, buckets: int = 8) -> None:
    """target holds one row a key: the newest by `order`. Buckets of keys that a batch touches are written anew as a next version."""
    columns = stream.columns

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        rows = batch.select(*columns, bucket)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets` rows
        if not touched:
            return
        old = current_rows(spark, target, touched, number)
        both = rows if old is None else rows.unionByName(old)
        best = both.groupBy("bucket", key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select("bucket", "r.*")
        best.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_rows(spark: SparkSession, target: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The rows of the newest version of each bucket (before a version, where one is named)."""
    if not _exists(spark, target):
        return None
    rows = spark.read.parquet(target)
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"]).drop("version")


def compacted(rows: DataFrame, key: str, parent: str, at: str, as_of, days: int = 35) -> DataFrame:
    """The newest row of each key within `days` of as_of, and the parents those rows need however old they are."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(at, "event_id")).alias("r")).select("r.*")
    young = newest.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
    needed = young.select(F.col(parent).alias(key)).distinct()
    return young.unionByName(newest.join(needed, key, "left_semi").join(young.select(key), key, "left_anti"))


def merged_cursors(old: DataFrame, polled: DataFrame) -> DataFrame:
    """source, cursor: the newest instant that a successful poll has read; a failed source keeps its cursor, none moves back."""
    fresh = polled.filter("ok").groupBy("source").agg(F.max("read_at").alias("read"))
    both = old.join(fresh, "source", "full_outer")
    return both.select("source", F.greatest("cursor", "read").alias("cursor"))


def rolling_counts(rows: DataFrame, key: str, at: str, as_of, windows: dict[str, int]) -> DataFrame:
    """key, and how many rows lie in each window of so many days before as_of (both ends count)."""
    inside = lambda days: (F.col(at) >= as_of - F.make_dt_interval(F.lit(days))) & (F.col(at) <= as_of)
    return rows.groupBy(key).agg(*[F.count_if(inside(days)).alias(name) for name, days in windows.items()])
