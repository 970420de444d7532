"""Helpers that the operators share: inputs and fixed hashes."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns of any name can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int):
    """Arrow batches of at most so many rows and bytes for the actions within: they bound the memory of a Python worker."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


#: Rows and bytes of an Arrow batch of texts, and the setting that Spark comes with (fixed values).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20))}


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes from here on, for plans that run later: where the session still has Spark's defaults."""
    for key, (default, wanted) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, wanted)


def lean(run):
    """run(batches) as it is; at its end the worker, which Spark keeps for other tasks, gives freed memory back to the system."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: An odd multiplier and the constants of the 64-bit finaliser (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_B
    return x ^ (x >> np.uint64(31))


PLACES = 64
with np.errstate(over="ignore"):
    #: A pseudo-random value for each place in a word and each byte, and an odd factor for each further PLACES bytes.
    TABLE = mix64(np.arange(PLACES * 256, dtype=np.uint64) * BASE + MIX_A)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span (in order, apart from each other), in one pass over the bytes: a sum of table values by place and byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        begun = np.zeros(len(data), np.int32)
        begun[starts[starts < len(data)]] = starts[starts < len(data)]
        place = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(begun)
        values = TABLE[((place & (PLACES - 1)) << 8) | data]
        if (ends - starts).max() > PLACES:
            values *= mix64((place // PLACES).astype(np.uint64) * BASE) | np.uint64(1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return mix64(total[ends] - total[starts] + (ends - starts).astype(np.uint64) * MIX_B)
