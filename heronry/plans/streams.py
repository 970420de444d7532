"""Queries that run the event log as a stream over all events and read the table it left."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.plans.base import query
from heronry.scratch import scratch_path
from heronry.streaming import log


def _replayed(spark, sf_dir):
    """The log after the events were streamed twice: the second pass holds only repeats."""
    base = scratch_path(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for part in ("a", "b"):
        events.write.parquet(f"{base}/in/{part}")
    stream = log.log_stream(spark, f"{base}/in/*", events.schema, "ts", ["event_id"])
    log.append_log(stream, f"{base}/log", f"{base}/progress")
    return log.read_log(spark, f"{base}/log")


@query("stm_04_stateful_dedupe", "SELECT event_id, user_id, event_type FROM events")
def stateful_dedupe(spark, sf_dir):
    return _replayed(spark, sf_dir).select("event_id", "user_id", "event_type")


@query("stm_07_tumbling_weeks", "SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_weeks(spark, sf_dir):
    return log.window_counts(_replayed(spark, sf_dir), "ts", "event_type")


@query("stm_09_current_table", "SELECT user_id, max(event_id) AS event_id, count(*) AS seen FROM events GROUP BY user_id")
def current_table(spark, sf_dir):
    return _replayed(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.count("*").alias("seen"))
