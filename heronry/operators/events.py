"""Event log operators: deduplication with conflicts, current rows, compaction, calendars, scores, streaks, plans.

Every instant that a result depends on is an argument. Orders end in a unique key, so results don't depend on arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe(events: DataFrame, keys: list[str], content: list[str], seen_at: str, on_conflict: str = "error") -> DataFrame:
    """One row per key, the earliest seen. Rows of one key with different content are an error, or with 'keep' counted in conflicts."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    rest = [c for c in events.columns if c not in keys]
    found = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(seen_at, digest)).alias("r"), F.countDistinct(digest).alias("versions"))
    if on_conflict == "error":
        found = found.withColumn("versions", F.when(F.col("versions") > 1, F.raise_error(F.concat(F.lit("conflicting content for "), F.to_json(F.struct(*keys)))).cast("long")).otherwise(F.col("versions")))
    return found.select(*keys, "r.*", (F.col("versions") - 1).alias("conflicts"))


def append_keeping_stored(stored: DataFrame, incoming: DataFrame, keys: list[str], content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored and accepted rows, incoming rows whose key is stored with other content)."""
    digest = lambda: F.sha2(F.to_json(F.struct(*content)), 256)
    accepted = incoming.join(stored.select(*keys), keys, "left_anti")
    known = stored.select(*keys, digest().alias("__stored"))
    conflicts = incoming.withColumn("__new", digest()).join(known, keys).filter("__stored <> __new").drop("__stored", "__new")
    return stored.unionByName(accepted), conflicts


def current(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns (the last of which must be unique)."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def compact(events: DataFrame, keys: list[str], order: list[str], at: str, as_of: Column, days: int = 35, parent: str | None = None, entity: str | None = None) -> DataFrame:
    """Current rows of the last `days` days, and the parents that they name."""
    rows = current(events, keys, order)
    recent = rows.filter(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
    if parent is None:
        return recent
    wanted = recent.select(F.col(parent).alias(entity)).dropna().distinct()
    return recent.unionByName(rows.join(wanted, entity, "left_semi")).dropDuplicates(keys)


def half_life_score(rows: DataFrame, group: str, author: str, at: str, key: str, as_of: Column, days: float = 3.5) -> DataFrame:
    """Sum of 0.5^(age / days) / k, k being the author's running number within the group."""
    order = Window.partitionBy(group, author).orderBy(at, key)
    age = (F.unix_micros(as_of) - F.unix_micros(F.col(at))) / F.lit(86_400e6)
    part = F.pow(F.lit(0.5), age / days) / F.col("k")
    return rows.withColumn("k", F.row_number().over(order)).groupBy(group).agg(F.sum(part).alias("score"))


def dense_counts(rows: DataFrame, calendar: DataFrame, bucket: str, covered_from: Column) -> DataFrame:
    """Count per calendar bucket: null before coverage, 0 inside it where nothing happened."""
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    return calendar.join(counts, bucket, "left").select(bucket, F.when(F.col(bucket) >= covered_from, F.coalesce("n", F.lit(0))).alias("n"))


def longest_streak(days: DataFrame, key: str, day: str) -> DataFrame:
    """Longest run of consecutive days per key."""
    order = Window.partitionBy(key).orderBy(day)
    runs = days.select(key, day).distinct().withColumn("island", F.date_sub(F.col(day), F.row_number().over(order)))
    return runs.groupBy(key, "island").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("streak"))


def failing_run(runs: DataFrame, job: str, at: str, ok: str) -> DataFrame:
    """How many of the newest runs in a row failed, per job."""
    order = Window.partitionBy(job).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("oks", F.sum(F.col(ok).cast("int")).over(order))
    return marked.groupBy(job).agg(F.sum(F.when(F.col("oks") == 0, 1).otherwise(0)).alias("failures"))


def spend_plan(calls: DataFrame, scope: str, order: str, estimate: str, cap: float) -> DataFrame:
    """Running total per scope; called while it stays within the cap (estimates aren't negative, so the first overflow ends it)."""
    running = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("total", F.sum(estimate).over(running)).withColumn("called", F.col("total") <= cap)


def capped(rows: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """The first `limit` rows per group, and how many more there are."""
    window = Window.partitionBy(group)
    numbered = rows.withColumn("position", F.row_number().over(window.orderBy(*order))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(window) - limit))
    return numbered.filter(F.col("position") <= limit)


def shelf_pack(items: DataFrame, scope: str, order: str, size: str, limit: int) -> DataFrame:
    """Shard numbers by filling in order: an item that would exceed the limit opens the next shard. Per scope, in sequence."""

    def fill(pdf):
        pdf, shard, held, out = pdf.sort_values(order), 0, 0, []
        for n in pdf[size]:
            if held and held + n > limit:
                shard, held = shard + 1, 0
            held += n
            out.append(shard)
        return pdf.assign(shard=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", shard int"
    return items.groupBy(scope).applyInPandas(fill, schema)


def dominant_pairs(pairs: DataFrame, left: str, right: str, item: str, least: int, dominance: float) -> DataFrame:
    """Pairs with at least `least` common items, and `dominance` times as many as the best competitor on either side."""
    counts = pairs.groupBy(left, right).agg(F.countDistinct(item).alias("n"))

    def best_two(side: str) -> DataFrame:
        """The two largest counts of each side, of salted parts first: no task sorts all pairs of one side."""
        top = lambda c: F.slice(F.sort_array(c, asc=False), 1, 2)
        parts = counts.groupBy(side, F.pmod(F.xxhash64(left, right), F.lit(32)).alias("salt")).agg(top(F.collect_list("n")).alias("t"))
        both = parts.groupBy(side).agg(top(F.flatten(F.collect_list("t"))).alias("t"))
        return both.select(side, F.get("t", F.lit(0)).alias(f"{side}_1"), F.coalesce(F.get("t", F.lit(1)), F.lit(0)).alias(f"{side}_2"))

    rival = lambda side: F.when(F.col("n") == F.col(f"{side}_1"), F.col(f"{side}_2")).otherwise(F.col(f"{side}_1"))
    told = counts.filter(F.col("n") >= least).join(best_two(left), left).join(best_two(right), right).withColumn("competitor", F.greatest(rival(left), rival(right)))
    return told.filter(F.col("n") >= dominance * F.col("competitor")).select(left, right, "n", "competitor")


def retained(releases: DataFrame, reasons: dict[str, DataFrame], key: str, made: str, before: Column) -> DataFrame:
    """Releases with the reasons that keep them; candidate: none, and made before the instant."""
    marks = None
    for reason, ids in reasons.items():
        part = ids.select(key).distinct().withColumn("reason", F.lit(reason))
        marks = part if marks is None else marks.unionByName(part)
    if marks is None:
        rows = releases.withColumn("reasons", F.lit(None).cast("array<string>"))
    else:
        rows = releases.join(marks.groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons")), key, "left")
    return rows.withColumn("candidate", F.col("reasons").isNull() & (F.col(made) < before))


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer difference of two key sets: key and side (both, left, right)."""
    a, b = (x.select(key).distinct().withColumn(side, F.lit(True)) for x, side in ((left, "l"), (right, "r")))
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def boundary_join(rows: DataFrame, bounds: DataFrame, value: str, low: str) -> DataFrame:
    """Each row's last boundary at or below its value; the boundaries, few by contract, are broadcast as intervals."""
    edges = bounds.withColumn("__high", F.lead(low).over(Window.orderBy(low)))
    inside = (F.col(value) >= F.col(low)) & (F.col("__high").isNull() | (F.col(value) < F.col("__high")))
    return rows.join(F.broadcast(edges), inside).drop("__high")
