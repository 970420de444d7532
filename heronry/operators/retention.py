"""What a store keeps: publication sets by window, floor and pins, releases with the reasons they stay for, and objects by mark and sweep.

Ids carry their time as a token (see `calendar.release_time`); an id without one is never a candidate. Nothing is deleted here: the
results name what may go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions import calendar as C
from heronry.scratch import discard, persisted

#: Days that a set is kept for, the newest sets that stay whatever their age, and hours that anything young stays (fixed values).
WINDOW_DAYS, FLOOR, GRACE_HOURS = 30, 2, 48


def time_token(release: Column) -> Column:
    """The part of an id that names its time; null where it has none."""
    found = F.regexp_extract(release, r"\d{8}T\d{6}Z", 0)
    return F.when(C.release_time(release).isNotNull(), found)


def retained_sets(sets: DataFrame, pinned: DataFrame, now: Column, floor: int = FLOOR, days: int = WINDOW_DAYS) -> DataFrame:
    """set_id, reason of the publication sets that stay: window, floor, pinned (a pinned release has the same time token), or untimed.

    sets: set_id; pinned: release.
    """
    if floor < 2:
        raise ValueError("a floor below two would let the live release or the one before go")
    timed = sets.select("set_id", C.release_time(F.col("set_id")).alias("at"), time_token(F.col("set_id")).alias("token")).distinct()
    newest = timed.filter("at IS NOT NULL").orderBy(F.desc("at"), "set_id").limit(floor).select("set_id", F.lit(True).alias("newest"))
    pins = pinned.select(time_token(F.col("release")).alias("token")).dropna().distinct().withColumn("pinned", F.lit(True))
    told = timed.join(newest, "set_id", "left").join(pins, "token", "left")
    reason = F.when(F.col("at").isNull(), "untimed").when(F.col("at") > now - F.make_dt_interval(F.lit(days)), "window").when(F.col("newest"), "floor").when(F.col("pinned"), "pinned")
    return told.select("set_id", reason.alias("reason")).filter("reason IS NOT NULL")


def classified_releases(listed: DataFrame, pins: DataFrame, named: DataFrame, kept_sets: DataFrame, now: Column, hours: int = GRACE_HOURS) -> DataFrame:
    """projection, release, reasons (sorted; empty: a candidate) of every listed release.

    listed: projection, release; pins: projection, release, reason; named: projection, release, set_id (releases that a set names);
    kept_sets: set_id, reason. A release stays for each pin, for each kept set that names it or shares its time token, while it is
    young, and where its id has no time.
    """
    at = C.release_time(F.col("release"))
    own = listed.select("projection", "release", F.when(at.isNull(), "untimed").when(at > now - F.make_dt_interval(hours=F.lit(hours)), "grace").alias("reason"))
    by_name = named.join(kept_sets, "set_id").select("projection", "release", "reason")
    tokens = kept_sets.select(time_token(F.col("set_id")).alias("token"), "reason").dropna().distinct()
    by_token = listed.withColumn("token", time_token(F.col("release"))).join(tokens, "token").select("projection", "release", "reason")
    reasons = own.unionByName(pins.select("projection", "release", "reason")).unionByName(by_name).unionByName(by_token)
    kept = reasons.groupBy("projection", "release").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))  # a handful of kinds
    return listed.distinct().join(kept, ["projection", "release"])


def reachable(roots: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """id of everything that the roots (id) reach along edges (from, to), roots included: the marks of a sweep.

    Each round follows the newest ids alone; cycles and repeated edges change nothing, edges with a null end are left out.
    """
    along = edges.select("from", "to").dropna()
    newest = persisted(roots.select("id").dropna().distinct(), "marks")
    rounds = [newest]
    for _ in range(most_rounds):
        known = rounds[0]
        for df in rounds[1:]:
            known = known.union(df)
        led = newest.join(along, F.col("id") == F.col("from")).select(F.col("to").alias("id")).distinct()
        newest = persisted(led.join(known, "id", "left_anti"), "marks")
        if newest.isEmpty():
            discard(newest)
            return known
        rounds.append(newest)
        if len(rounds) > 8:  # rounds become one table, so a long chain of manifests doesn't make a long plan
            merged = persisted(known.union(newest), "marks")
            for df in rounds[:-1]:
                discard(df)
            rounds = [merged]
    raise RuntimeError(f"marks did not settle in {most_rounds} rounds")


def sweepable(pool: DataFrame, marks: DataFrame, now: Column, hours: int = GRACE_HOURS) -> DataFrame:
    """The rows of pool (id, uploaded) that no mark names and that are older than the grace period; an unknown age is young."""
    return pool.filter(F.col("uploaded") < now - F.make_dt_interval(hours=F.lit(hours))).join(marks.select("id"), "id", "left_anti")

