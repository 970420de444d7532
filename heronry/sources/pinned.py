"""Reading one release while others are published: the pointer is read once, and everything after it comes from that release's own files.

A release is never changed, so a reader that has pinned one sees it whole however often the pointer moves. Details lie in folders by a
shard of their key, and a reader of some keys opens those folders alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronry.sinks import release as R

SHARDS = 16


def shard(key: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(shards)).cast("int")


def publish_details(rows: DataFrame, key: str, root: str, release: str) -> None:
    """Write rows as details of a release, list them in its manifest (key, sha256, shard), verify them, and switch the pointer.

    The pointer moves last: a run that dies before leaves files that nothing names.
    """
    spark = rows.sparkSession
    body = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    details = rows.select("*", R.digest(body).alias("sha256"), shard(F.col(key)).alias("shard"))
    base = f"{root}/releases/{release}"
    details.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{base}/details")
    stored = spark.read.schema(details.schema).parquet(f"{base}/details").select(F.col(key).alias("key"), "sha256", "shard")
    stored.write.mode("overwrite").parquet(f"{base}/manifest")
    declared = details.select(F.col(key).alias("key"), "sha256", F.lit(0).alias("bytes"))
    R.publish(spark, f"{root}/current", release, R.verification(declared, stored.withColumn("bytes", F.lit(0))), schema=details.schema.json())


@dataclass(frozen=True)
class PinnedRelease:
    """One release as it was when it was pinned."""

    root: str
    release: str
    schema: str

    @property
    def base(self) -> str:
        return f"{self.root}/releases/{self.release}"

    def manifest(self, spark: SparkSession) -> DataFrame:
        """key, sha256, shard."""
        return spark.read.parquet(f"{self.base}/manifest")

    def details(self, spark: SparkSession, keys: DataFrame | None = None, key: str = "key", listed: int = 10_000) -> DataFrame:
        """Details of all keys, or of those in `keys` (one column named as the details' key).

        Up to `listed` keys are taken to the driver so that only their shards are opened; more are joined.
        """
        rows = spark.read.schema(StructType.fromJson(json.loads(self.schema))).parquet(f"{self.base}/details")
        if keys is None:
            return rows.drop("shard")
        wanted = keys.select(F.col(key)).distinct()
        some = wanted.select(key, shard(F.col(key)).alias("shard")).limit(listed + 1).collect()
        if len(some) > listed:
            return rows.join(wanted, key, "left_semi").drop("shard")
        return rows.filter(F.col("shard").isin(sorted({r.shard for r in some})) & F.col(key).isin([r[key] for r in some])).drop("shard")


def pin(spark: SparkSession, root: str) -> PinnedRelease:
    """The release that is current now; an error where none has been published."""
    pointer = R.read_pointer(spark, f"{root}/current")
    if pointer is None:
        raise FileNotFoundError(f"nothing has been published at {root}")
    return PinnedRelease(root, pointer["release"], pointer["schema"])
