"""Spark session with the settings that the engine's results rely on (UTC, AQE, Arrow)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session for the given master; a cluster's own settings win where nothing is passed."""
    builder = (
        SparkSession.builder.appName("heronry")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def workers_import_from(spark: SparkSession, folder: str) -> None:
    """Let Python workers that start from now on import modules in `folder`, as the driver does, wherever it was started."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if folder not in known.split(":"):
        environment["PYTHONPATH"] = f"{folder}:{known}".rstrip(":")
