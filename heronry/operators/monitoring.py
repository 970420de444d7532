"""Monitoring rules over runs, components, budgets, caches and links; every instant is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_states(runs: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """job, state of every job (job, interval_hours): failing, stale (no success for three intervals), late (for one) or ok."""
    last = runs.groupBy("job").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("success"), F.max_by("ok", "at").alias("last_ok"))
    age = (F.unix_micros(now) - F.unix_micros("success")) / 3_600_000_000
    state = F.when(F.col("success").isNull() | (age > 3 * F.col("interval_hours")), "stale").when(~F.col("last_ok"), "failing").when(age > F.col("interval_hours"), "late").otherwise("ok")
    return jobs.join(last, "job", "left").select("job", state.alias("state"))


def component_health(states: DataFrame, members: DataFrame, worst: list[str]) -> DataFrame:
    """component, health: the worst state of its jobs; `worst` lists states from bad to good, a job without a state is the first."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, worst)), F.col("state")).cast("int"), F.lit(1))
    return members.join(states, "job", "left").groupBy("component").agg(F.get(F.array(*map(F.lit, worst)), F.min(F.greatest(rank, F.lit(1))) - 1).alias("health"))


def rolled_up(parts: DataFrame, key: str) -> DataFrame:
    """key, status of a run from its parts: ok if all are, failed if none is, else partial."""
    good = F.count_if(F.col("ok"))
    return parts.groupBy(key).agg(F.when(good == F.count("*"), "ok").when(good == 0, "failed").otherwise("partial").alias("status"))


def spend_gate(calls: DataFrame, scope: str, order: str, cap: float) -> DataFrame:
    """calls with `allowed`: what earlier calls have settled, plus this call's estimate, is at most cap. A call that isn't allowed settles nothing,
    and once one is refused, none after it is allowed: so the prefix sum of settled costs decides."""
    before = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    fits = (F.coalesce(F.sum("settled").over(before), F.lit(0.0)) + F.col("estimate")) <= cap
    upto = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("_fits", fits).withColumn("allowed", F.min(F.col("_fits").cast("int")).over(upto) == 1).drop("_fits")


def continuation(done: Column, wanted: Column, failed_at: Column, now: Column, pause_minutes: int) -> Column:
    """When the next run is due: null where nothing is left, after the pause where the last run failed, else now."""
    return F.when(done >= wanted, F.lit(None).cast("timestamp")).when(failed_at.isNotNull(), F.greatest(now, failed_at + F.make_dt_interval(mins=F.lit(pause_minutes)))).otherwise(now)


def cache_source(cached_at: Column, fetched: Column, now: Column, hours: int = 24) -> Column:
    """Where a cached table comes from: fresh cache, a new fetch where the cache is older, the stale cache where the fetch failed, or none."""
    fresh = cached_at >= now - F.make_dt_interval(hours=F.lit(hours))
    return F.when(fresh, "cache").when(fetched, "fetch").when(cached_at.isNotNull(), "stale").otherwise("none")


def reused_rows(fresh: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows of candidates: the fresh one where it could be fetched (column ok), else the previous one, marked reused."""
    old = previous.select(key, F.struct(*[c for c in previous.columns if c != key]).alias("_old"))
    columns = [c for c in previous.columns if c != key]
    both = fresh.join(old, key, "left").filter("ok OR _old IS NOT NULL")
    return both.select(key, *[F.when(F.col("ok"), F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns], (~F.col("ok")).alias("reused"))


def refreshed(stored: DataFrame, changed: DataFrame, key: str, most: int) -> DataFrame:
    """stored with changed rows in place of those of the same key; more than `most` changed rows are an error."""
    if changed.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows changed")
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed)


def golden_issues(queries: DataFrame, judgments: DataFrame, chunks: DataFrame) -> DataFrame:
    """query, issue of an evaluation set: judgments of unknown queries or chunks, grades out of 0 to 3, queries without a relevant chunk."""
    unknown_query = judgments.join(queries.select("query"), "query", "left_anti").select("query", F.lit("unknown query").alias("issue"))
    unknown_chunk = judgments.join(chunks.select("chunk"), "chunk", "left_anti").select("query", F.lit("unknown chunk").alias("issue"))
    grade = judgments.filter("grade IS NULL OR grade NOT BETWEEN 0 AND 3").select("query", F.lit("grade").alias("issue"))
    empty = queries.join(judgments.filter("grade > 0").select("query"), "query", "left_anti").select("query", F.lit("nothing relevant").alias("issue"))
    return unknown_query.unionByName(unknown_chunk).unionByName(grade).unionByName(empty).distinct()


def link_issues(declared: DataFrame, known: DataFrame) -> DataFrame:
    """a, b, issue of declared links: an end that isn't known, a link to itself, or a repeat in either direction."""
    ends = known.select("id").distinct()
    missing = declared.join(ends.select(F.col("id").alias("a"), F.lit(True).alias("_a")), "a", "left").join(ends.select(F.col("id").alias("b"), F.lit(True).alias("_b")), "b", "left")
    pair = [F.least("a", "b"), F.greatest("a", "b")]
    repeats = missing.withColumn("_k", F.count("*").over(Window.partitionBy(*pair)))
    issue = F.when(F.col("a") == F.col("b"), "self").when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown").when(F.col("_k") > 1, "repeat")
    return repeats.select("a", "b", issue.alias("issue")).filter("issue IS NOT NULL")


def lag_notes(sources: DataFrame, as_of: Column, days: int = 1) -> DataFrame:
    """source, note for sources (source, newest) that lag by `days` or more whole days, or have nothing."""
    behind = F.floor((F.unix_micros(as_of) - F.unix_micros("newest")) / 86_400_000_000)
    note = F.when(F.col("newest").isNull(), "nothing recorded").when(behind >= days, F.concat(behind.cast("string"), F.lit(" days behind")))
    return sources.select("source", note.alias("note")).filter("note IS NOT NULL")


def graded(found: DataFrame, expected: DataFrame) -> DataFrame:
    """case, recall, precision of a diagnosis' evidence (case, evidence) against what was expected."""
    e, f = expected.select("case", "evidence").distinct().withColumn("_e", F.lit(1)), found.select("case", "evidence").distinct().withColumn("_f", F.lit(1))
    both = e.join(f, ["case", "evidence"], "full_outer")
    hit = F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull())
    return both.groupBy("case").agg((hit / F.nullif(F.count("_e"), F.lit(0))).alias("recall"), (hit / F.nullif(F.count("_f"), F.lit(0))).alias("precision"))


def section_issues(books: DataFrame, sections: DataFrame, anchors: DataFrame, required: list[str]) -> DataFrame:
    """book, issue: required sections that a book lacks, and anchors (book, target) that name no section."""
    wanted = books.select("book", F.explode(F.array(*map(F.lit, required))).alias("section"))
    lacking = wanted.join(sections, ["book", "section"], "left_anti").select("book", F.concat(F.lit("no section "), "section").alias("issue"))
    dangling = anchors.join(sections.select("book", F.col("section").alias("target")), ["book", "target"], "left_anti").select("book", F.concat(F.lit("no target "), "target").alias("issue"))
    return lacking.unionByName(dangling)


def month_span(first: Column, last: Column) -> Column:
    """All months YYYY-MM from one instant's to another's; none if they are the wrong way round."""
    a, b = F.trunc(first, "month"), F.trunc(last, "month")
    return F.when(a > b, F.expr("cast(array() AS array<string>)")).otherwise(F.transform(F.sequence(a, b, F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM")))


def halves(keys: Column, failed: Column) -> Column:
    """The batches that a failed batch is tried again in: its two halves, or nothing once it is a single key."""
    half = F.ceil(F.size(keys) / 2).cast("int")
    return F.when(failed & (F.size(keys) > 1), F.array(F.slice(keys, 1, half), F.slice(keys, half + 1, F.size(keys)))).otherwise(F.expr("cast(array() AS array<array<string>>)"))
