"""Intermediate tables in shared storage: they cut lineage, are computed once and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset (tests, one machine)."""
    global _OWN
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="heronry-scratch-")
    return f"file://{_OWN}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/heronry/{name}-{uuid.uuid4().hex}"


_PATHS: dict[int, str] = {}


def persisted(df: DataFrame, name: str) -> DataFrame:
    """df written once to shared storage and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what persisted() has written for this very frame; nothing that is still to run may read it."""
    path, spark = _PATHS.pop(id(df), None), df.sparkSession
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
