"""Listing of stored files: fingerprints of inputs, disjoint key ranges of a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Number, bytes and newest change of the files under a path, from the file system's own summary."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = files.getContentSummary(place)
    return summary.getFileCount(), summary.getLength(), files.getFileStatus(place).getModificationTime()


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the files under a path, without their bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def key_ranges(prefix: str, bounds: list[str]) -> list[tuple[str, str | None]]:
    """Disjoint half-open ranges (from, to) that cover all keys with a prefix; the last is open."""
    edges = [prefix, *sorted({prefix + b for b in bounds if b})]
    return list(zip(edges, [*edges[1:], None], strict=True))


def range_of(key: Column, ranges: list[tuple[str, str | None]]) -> Column:
    """Number of the range that holds a key; null for keys outside."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(ranges):
        out = F.when((key >= low) & (F.lit(True) if high is None else key < high), i).otherwise(out)
    return out
