"""Queries of monitoring rules and of JSON and document functions: on the test tables where they fit, else on case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import monitoring as M
from heronry.plans.base import query, table

col = F.col
NOW = "2024-01-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")



RUNS = "r AS (SELECT event_type || user_id % 4 AS job, ts AS tm, value > 100 AS ok FROM events)"
STATES = f"""{RUNS},
st AS (SELECT job, CASE WHEN s IS NULL OR s < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 36 HOUR THEN 'stale' WHEN NOT l THEN 'failing' WHEN s < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 12 HOUR THEN 'late' ELSE 'ok' END AS state FROM (SELECT job, max(tm) FILTER (ok) AS s, arg_max(ok, tm) AS l FROM r WHERE tm <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY job))"""


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id") % 4).alias("job"), F.col("ts").alias("at"), (F.col("value") > 100).alias("ok")).filter(F.col("at") <= _now())


def _states(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return M.run_states(runs, runs.select("job").distinct().withColumn("interval_hours", F.lit(12)), _now())


@query("ops_02_run_states", f"WITH {STATES} SELECT job, state FROM st")
def run_states(spark, sf_dir):
    return _states(spark, sf_dir)


@query("ops_04_component_health", f"WITH {STATES} SELECT right(job, 1) AS component, (['stale', 'failing', 'late', 'ok'])[min(CASE state WHEN 'stale' THEN 1 WHEN 'failing' THEN 2 WHEN 'late' THEN 3 ELSE 4 END)] AS health FROM st GROUP BY 1")
def component_health(spark, sf_dir):
    members = _runs(spark, sf_dir).select("job").distinct().withColumn("component", F.right("job", F.lit(1)))
    return M.component_health(_states(spark, sf_dir), members, ["stale", "failing", "late", "ok"])


@query("agg_47_rolled_up", "SELECT user_id, CASE WHEN count_if(value > 100) = count(*) THEN 'ok' WHEN count_if(value > 100) = 0 THEN 'failed' ELSE 'partial' END AS status FROM events GROUP BY user_id")
def rolled_up(spark, sf_dir):
    return M.rolled_up(table(spark, sf_dir, "events").select("user_id", (F.col("value") > 100).alias("ok")), "user_id")


@query(
    "ops_10_spend_gate",
    """WITH c AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS settled FROM events),
    p AS (SELECT *, coalesce(sum(settled) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 60 <= 300 AS fits FROM c)
    SELECT event_id, bool_and(fits) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS allowed FROM p""",
)
def spend_gate(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("double").alias("settled"), F.lit(60.0).alias("estimate"))
    return M.spend_gate(calls, "user_id", "event_id", 300.0).select("event_id", "allowed")


@query("ops_17_reused", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars ELSE n_chars + 1 END AS n, doc_id % 4 = 0 AS reused FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 <> 0")
def reused(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n"))
    fresh = docs.select("doc_id", (F.col("n") + 1).alias("n"), (F.col("doc_id") % 4 != 0).alias("ok"))
    return M.reused_rows(fresh, docs.filter("doc_id % 3 <> 0"), "doc_id")


@query("ops_18_refreshed", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN upper(url) ELSE url END AS url FROM pages")
def refreshed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return M.refreshed(pages, pages.filter("page_id % 7 = 0").withColumn("url", F.upper("url")), "page_id", 1_000_000)


@query("ops_26_lag_notes", "SELECT event_type AS source, (floor((epoch_us(TIMESTAMP '2024-02-10') - epoch_us(max(ts))) / 86400000000.0))::BIGINT || ' days behind' AS note FROM events GROUP BY event_type")
def lag_notes(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("newest"))
    return M.lag_notes(newest, F.lit("2024-02-10").cast("timestamp"))
