"""Reviews and people: monthly rows, profiles, suppression, pairs that dominate, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_rows(events: DataFrame, person: str, thread: str, kind: str, at: str) -> DataFrame:
    """person, month, and for each what they did: events, threads, days, by kind as a map."""
    month = F.date_format(at, "yyyy-MM").alias("month")
    by_kind = events.groupBy(person, month, kind).agg(F.count("*").alias("n"))
    kinds = by_kind.groupBy(person, "month").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"))
    totals = events.groupBy(person, month).agg(F.count("*").alias("events"), F.count_distinct(thread).alias("threads"), F.count_distinct(F.to_date(at)).alias("days"))
    return totals.join(kinds, [person, "month"])


def profile_totals(reviews: DataFrame, person: str, hidden: Column) -> DataFrame:
    """person, reviews, items, by_state, comments, reviewers: distinct reviewers, where hidden ones count one for each review."""
    states = reviews.groupBy(person, "state").agg(F.count("*").alias("n")).groupBy(person).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("by_state"))
    seen = F.when(~hidden, F.col("reviewer"))
    totals = reviews.groupBy(person).agg(F.count("*").alias("reviews"), F.count_distinct("item").alias("items"), F.sum("comments").alias("comments"), (F.count_distinct(seen) + F.count_if(hidden)).alias("reviewers"))
    return totals.join(states, person)


def suppressed(rows: DataFrame, project: str, person: str, digests: DataFrame, drop: bool = True) -> DataFrame:
    """Rows without people whose digest (SHA-256 of project and id) is listed; with drop=False the person is null instead."""
    marked = rows.withColumn("_digest", F.sha2(F.concat_ws(":", F.lit(project), F.col(person).cast("string")), 256))
    listed = digests.select(F.col("digest").alias("_digest")).distinct()
    if drop:
        return marked.join(listed, "_digest", "left_anti").drop("_digest")
    named = marked.join(listed.withColumn("_hit", F.lit(True)), "_digest", "left")
    return named.withColumn(person, F.when(F.col("_hit").isNull(), F.col(person))).drop("_digest", "_hit")


def dominant_pairs(counts: DataFrame, a: str, b: str, least: int, over_a: float, over_b: float) -> DataFrame:
    """Pairs (a, b, n) with n >= least that are over_a times the best other pair of a, and over_b times that of b.

    By the two best counts of each side, gathered in salted parts first, so a side of very many pairs makes no large group.
    """

    def best(side: str) -> DataFrame:
        top = F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 2)
        firsts = counts.groupBy(side, F.pmod(F.xxhash64(a, b), F.lit(16)).alias("salt")).agg(top.alias("t"))
        both = firsts.groupBy(side).agg(F.slice(F.sort_array(F.flatten(F.collect_list("t")), asc=False), 1, 2).alias("t"))
        return both.select(side, F.get("t", F.lit(0)).alias(f"{side}_1"), F.coalesce(F.get("t", F.lit(1)), F.lit(0)).alias(f"{side}_2"))

    rows = counts.filter(F.col("n") >= least).join(best(a), a).join(best(b), b)
    rival = lambda side: F.when(F.col("n") == F.col(f"{side}_1"), F.col(f"{side}_2")).otherwise(F.col(f"{side}_1"))
    return rows.filter((F.col("n") >= over_a * rival(a)) & (F.col("n") >= over_b * rival(b))).select(a, b, "n")


def merged_extras(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the newer table's value stands; a null there deletes."""
    n = new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_told"))
    both = old.select(key, F.col(value).alias("_old")).join(n, key, "full_outer")
    out = both.withColumn(value, F.when(F.coalesce("_told", F.lit(False)), F.col("_new")).otherwise(F.col("_old")))
    return out.filter(F.col(value).isNotNull()).select(key, value)


def proposal_rows(threads: DataFrame, key: str, stage: str, at: str, thread: str) -> DataFrame:
    """key, stages (sorted set), cites (threads, newest first), newest."""
    cites = F.transform(F.sort_array(F.collect_list(F.struct(at, thread)), asc=False), lambda x: x[thread])
    return threads.groupBy(key).agg(F.array_sort(F.collect_set(stage)).alias("stages"), F.max(at).alias("newest"), cites.alias("cites"))


def stage_candidates(threads: DataFrame, key: str) -> DataFrame:
    """One thread for each key: the newest vote, else the newest discussion; keys with a result are done. threads: key, thread, stage, at."""
    best = lambda name: F.max_by("thread", F.when(F.col("stage") == name, F.struct("at", "thread"))).alias(name)
    rows = threads.groupBy(key).agg(best("vote"), best("discuss"), F.count_if(F.col("stage") == "result").alias("done"))
    return rows.filter("done = 0 AND coalesce(vote, discuss) IS NOT NULL").select(key, F.coalesce("vote", "discuss").alias("thread"), F.when(F.col("vote").isNotNull(), "vote").otherwise("discuss").alias("stage"))


def first_facts(rows: DataFrame, key: str, person: str, at: str) -> DataFrame:
    """key, writers (sorted set), newest person and first time."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(person)).alias("writers"), F.max_by(person, F.struct(at, person)).alias("newest"), F.min(at).alias("first"))
