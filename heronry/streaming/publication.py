"""A log whose batches count once they are published: append, build and verify a release, move the pointer, and only then commit.

A batch that runs again, because a step after the append failed, writes its own files over and builds its release anew; the pointer
names the batch, so a published batch changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronry.sinks import release as R


def publish_batches(stream: DataFrame, root: str, key: str, checkpoint: str, built: Callable[[DataFrame], DataFrame]) -> None:
    """Every micro-batch: append it to root/log, write built(log) as release r<batch>, verify its keys, and switch root/current."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pointer = R.read_pointer(spark, f"{root}/current")
        if pointer is not None and int(pointer["release"][1:]) >= number:
            return
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={number}")
        log = spark.read.schema(batch.schema).option("basePath", f"{root}/log").parquet(*[f"{root}/log/batch={k}" for k in range(number + 1)])
        rows = built(log.select(*batch.columns))
        rows.write.mode("overwrite").parquet(f"{root}/releases/r{number}")
        stored = spark.read.schema(rows.schema).parquet(f"{root}/releases/r{number}")
        mark = lambda df: df.select(F.col(key).alias("key"), R.digest(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).alias("sha256"), F.lit(0).alias("bytes"))
        R.publish(spark, f"{root}/current", f"r{number}", R.verification(mark(rows), mark(stored)), schema=rows.schema.json())

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def published(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the release that is current."""
    pointer = R.read_pointer(spark, f"{root}/current")
    if pointer is None:
        raise FileNotFoundError(f"nothing has been published at {root}")
    return spark.read.schema(StructType.fromJson(json.loads(pointer["schema"]))).parquet(f"{root}/releases/{pointer['release']}")
