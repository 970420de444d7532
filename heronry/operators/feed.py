"""The feed: events grouped into threads through trusted relationships, with the newest state, activity and order of each thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.operators.graph import connected_components

#: Kinds of relationship that make two records one thread (fixed values).
GROUPING = ("reply-to", "part-of", "resolves", "same-change")


def trusted(kind: Column, origin: Column, approved: Column) -> Column:
    """A grouping kind that a source states, or that a model proposes and someone has approved."""
    return kind.isin(*GROUPING) & ((origin != "model") | F.coalesce(approved, F.lit(False)))


def latest_versions(events: DataFrame) -> DataFrame:
    """Of the events (record, at, event_id, ...) of each record the newest; ties by event_id."""
    newest = events.groupBy("record").agg(F.max_by(F.struct("*"), F.struct("at", "event_id")).alias("e"))
    return newest.select("e.*")


def thread_roots(records: DataFrame, relations: DataFrame) -> DataFrame:
    """record, root of every record: the root is its thread's oldest record (then the smallest id).

    relations: record, other, kind, origin, approved. Those that aren't trusted, or name a record that isn't there, join nothing.
    """
    links = relations.filter(trusted(F.col("kind"), F.col("origin"), F.col("approved"))).select(F.col("record").alias("a"), F.col("other").alias("b"))
    here = records.select("record")
    links = links.join(here.withColumnRenamed("record", "a"), "a", "left_semi").join(here.withColumnRenamed("record", "b"), "b", "left_semi")
    named = records.join(connected_components(links).withColumnRenamed("id", "record"), "record", "left").withColumn("component", F.coalesce("root", "record"))
    oldest = named.groupBy("component").agg(F.min_by("record", F.struct("at", "record")).alias("root"))
    return named.drop("root").join(oldest, "component").select("record", "root")


def feed(events: DataFrame, relations: DataFrame, as_of: str, days: int = 7, most: int = 50) -> DataFrame:
    """The `most` liveliest threads: root, title, status, n_records, n_people, activity (events of the last `days`), newest, rank.

    events: event_id, record, at, author, title, status; the newest event of a record is its state. Bots count nowhere. Order:
    activity, newest, root.
    """
    people = events.filter(~F.lower(F.coalesce("author", F.lit(""))).endswith("[bot]"))
    states = latest_versions(events)
    first = events.groupBy("record").agg(F.min("at").alias("at"))
    roots = thread_roots(first, relations)
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = (F.col("at") >= since) & (F.col("at") <= F.lit(as_of).cast("timestamp"))
    lively = people.join(roots, "record").groupBy("root").agg(F.count_distinct("author").alias("n_people"), F.count_if(recent).alias("activity"))
    named = states.join(roots, "record").groupBy("root").agg(F.count("*").alias("n_records"), F.max("at").alias("newest"), F.max(F.when(F.col("record") == F.col("root"), F.col("title"))).alias("title"), F.max_by("status", F.struct("at", "record")).alias("status"))
    rows = named.join(lively, "root", "left").select("root", "title", "status", "n_records", F.coalesce("n_people", F.lit(0)).alias("n_people"), F.coalesce("activity", F.lit(0)).alias("activity"), "newest")
    top = rows.orderBy(F.desc("activity"), F.desc("newest"), "root").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("activity"), F.desc("newest"), "root")))
