"""Gates that data pass before they count: events against their schema, payloads against the contract they name, and month and front-matter plans.

A gate gives every row the list of what is wrong with it; rows without an issue pass. Nothing raises on a row, so one bad row never
stops a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.functions import calendar as C

#: What an event may say (fixed values).
REQUIRED = ["id", "projectId", "sourceType", "entityType", "entityId", "eventType", "canonicalUrl"]
KINDS = {
    "sourceType": ["wiki", "issue-tracker", "code-host", "mailing-list", "forum", "chat", "other"],
    "entityType": ["artifact", "thread", "message", "contributor"],
    "eventType": ["observed", "created", "updated", "state-changed", "linked"],
}
INSTANTS = ["sourceTimestamp", "observedAt"]
NO_ISSUES = "cast(array() AS array<string>)"


def _when(test: Column, issue: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(issue))


def _empty(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def event_issues(data: Column) -> Column:
    """Issues of an event row (columns as the schema names them, all text; data: a map of its payload), sorted."""
    col = F.col
    checks = [_when(_empty(col(c)), f"{c} must be a non-empty string") for c in REQUIRED]
    checks += [_when(~F.coalesce(col(c).isin(known), F.lit(False)), f"{c} is not supported") for c, known in KINDS.items()]
    checks += [_when(~F.coalesce(col(c).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"), F.lit(False)) | C.instant(col(c)).isNull(), f"{c} must be UTC ISO-8601") for c in INSTANTS]
    checks += [_when(~F.coalesce(col("canonicalUrl").rlike(r"^https?://[^\s/]+"), F.lit(False)), "canonicalUrl must be an HTTP(S) URL"), _when(data.isNull(), "data must be an object")]
    changed = col("eventType") == "state-changed"
    checks.append(_when(changed & (col("entityType") != "artifact"), "state-changed event must target an artifact"))
    for field in ("artifactType", "after"):
        checks.append(_when(changed & data.isNotNull() & _empty(data[field]), f"data.{field} must be a non-empty string"))
    return F.array_sort(F.array_compact(F.array(*checks)))


def gated(events: DataFrame, data: str = "data") -> DataFrame:
    """The rows with their issues; those that pass have none."""
    return events.withColumn("issues", event_issues(F.col(data)))


def payload_issues(contract: Column, payload: Column, contracts: dict[str, dict[str, str]]) -> Column:
    """Issues of a JSON payload by the contract it names: fields that lack or have another type than the contract's (string, number, boolean)."""
    parsed = F.try_parse_json(payload)
    out = F.array(F.lit("unknown contract"))
    for name, fields in contracts.items():
        found = []
        for field, kind in fields.items():
            value = F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))
            fits = {"string": value == "STRING", "number": value.rlike("^(BIGINT|DOUBLE|DECIMAL)"), "boolean": value == "BOOLEAN"}[kind]
            found.append(_when(~F.coalesce(fits, F.lit(False)), f"{field} must be a {kind}"))
        out = F.when(contract == name, F.when(parsed.isNull(), F.array(F.lit("payload must be an object"))).otherwise(F.array_compact(F.array(*found)))).otherwise(out)
    return out


def profile_issues(profiles: DataFrame) -> DataFrame:
    """profile, issue of community profiles (profile, version, source, instance): a version that isn't positive, no source, or one source instance twice."""
    counted = profiles.groupBy("profile").agg(F.max("version").alias("version"), F.count("source").alias("sources"))
    bad = counted.select("profile", F.explode(F.array_compact(F.array(_when(~F.coalesce(F.col("version") > 0, F.lit(False)), "version must be positive"), _when(F.col("sources") == 0, "no source")))).alias("issue"))
    twice = profiles.dropna(subset=["source"]).groupBy("profile", "source", "instance").agg(F.count("*").alias("n")).filter("n > 1").select("profile", F.concat(F.lit("repeated source "), "source", F.lit(" "), "instance").alias("issue"))
    return bad.unionByName(twice)


def backfilled_month(nodes: DataFrame, assignees: DataFrame, month: str) -> DataFrame:
    """thread, kind, author, assignee, keys of one month: pulls made in it whose titles hold keys, and the issues of those keys that were answered.

    nodes: number, title, author, bot, created_at, keys; assignees: key, assignee. A bot is no author; an issue without an answer has no
    thread; keys are in natural order.
    """
    kept = nodes.filter((C.month(F.col("created_at")) == month) & (F.size("keys") > 0))
    natural = F.transform(F.array_sort(F.transform(F.array_distinct("keys"), lambda k: F.struct(F.regexp_extract(k, r"(\d+)$", 1).cast("long").alias("n"), k.alias("k")))), lambda x: x["k"])
    pulls = kept.select(F.concat(F.lit("PR-"), "number").alias("thread"), F.lit("pull-request").alias("kind"), F.when(~F.col("bot"), F.col("author")).alias("author"), F.lit(None).cast("string").alias("assignee"), natural.alias("keys"))
    keys = kept.select(F.explode("keys").alias("key")).distinct()
    issues = assignees.join(keys, "key", "left_semi").select(F.col("key").alias("thread"), F.lit("issue").alias("kind"), F.lit(None).cast("string").alias("author"), "assignee", F.array("key").alias("keys"))
    return pulls.unionByName(issues)


def front_matter_plan(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """id, plan (missing, unchanged or changed), fields that drift: notes (id, fields: map) against polled pages (id, fields: map)."""
    both = pages.select("id", F.col("fields").alias("new")).join(notes.select("id", F.col("fields").alias("old")), "id", "left")
    drift = F.array_sort(F.filter(F.map_keys("new"), lambda k: ~F.col("old")[k].eqNullSafe(F.col("new")[k])))
    plan = F.when(F.col("old").isNull(), "missing").when(F.size(drift) > 0, "changed").otherwise("unchanged")
    return both.select("id", plan.alias("plan"), F.when(F.col("old").isNotNull(), drift).otherwise(F.expr(NO_ISSUES)).alias("drift"))


def trend(coverage: DataFrame, months: DataFrame, now: Column, lag_hours: int = 48) -> DataFrame:
    """project, visible, stale, marker, years of activity trends.

    coverage: project, recorded, since, until; months: project, month. A trend shows if any series is recorded, is stale if its newest is
    older than the lag, has a marker where a recorded series begins after its first month, and marks each January but the first month.
    """
    first = months.groupBy("project").agg(F.min("month").alias("first"), F.array_sort(F.collect_set(F.when(F.col("month").endswith("-01"), F.substring("month", 1, 4)))).alias("januaries"))
    rows = coverage.join(first, "project")
    later = F.col("recorded") & (F.col("since") > F.to_timestamp(F.concat("first", F.lit("-01"))))
    told = rows.groupBy("project", "first", "januaries").agg(F.bool_or("recorded").alias("visible"), F.max("until").alias("until"), F.min(F.when(later, F.col("since"))).alias("marker"))
    stale = F.coalesce(F.unix_micros(now) - F.unix_micros("until") > lag_hours * 3_600_000_000, F.lit(False))
    years = F.filter("januaries", lambda y: y != F.when(F.col("first").endswith("-01"), F.substring("first", 1, 4)).otherwise(""))
    return told.select("project", "visible", stale.alias("stale"), "marker", years.alias("years"))


def kinds(threads: DataFrame, chosen: str = "all") -> DataFrame:
    """kind, n of threads (thread, kind): all, and each kind that readers may choose; `chosen` keeps one."""
    shown = threads.filter(F.lit(chosen == "all") | (F.col("kind") == chosen))
    one = shown.groupBy("kind").agg(F.count("*").alias("n")).filter(F.col("kind").isin("pr", "mail", "jira"))
    return one.unionByName(shown.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), "n"))


def run_cost(calls: DataFrame, changed_since: Column) -> DataFrame:
    """stage, cold, steady: units that a first run costs, and one that only calls for what has changed since an instant."""
    return calls.groupBy("stage").agg(F.sum("units").alias("cold"), F.coalesce(F.sum(F.when(F.col("changed_at") > changed_since, F.col("units"))), F.lit(0)).alias("steady"))

