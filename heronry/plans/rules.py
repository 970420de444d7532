"""Health rules, budgets, publication checks and sources, as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.plans.base import both, query, table
from heronry.sources import captures

both("ops_05_breaker", "WITH s AS (SELECT user_id, event_id, max(CASE WHEN value > 150 THEN event_id ELSE -1 END) OVER w AS opened, max(CASE WHEN event_type = 'signup' THEN event_id ELSE -1 END) OVER w AS reset_at FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, opened > reset_at AS latched FROM s", tables="events")
both("ops_08_citations", "SELECT item, CASE WHEN found THEN 'resolved' ELSE 'dangling' END AS state FROM (SELECT l.doc_id AS item, d.doc_id IS NOT NULL AND d.n_chars > 100 AS found FROM {labels} l LEFT JOIN {documents} d ON l.doc_id = d.doc_id) t", tables="labels documents")
both("ops_14_publication_issues", "SELECT conv_id, 'first turn is no user turn' AS issue FROM {conversations} WHERE turn = 0 AND role <> 'user' UNION ALL SELECT conv_id, 'repeated role' AS issue FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {conversations}) c WHERE role = before", tables="conversations")
both("ops_28_recorded_sources", "SELECT lang, array_join(array_sort(collect_set(source)), ',') AS sources FROM {documents} GROUP BY lang", "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM {documents} GROUP BY lang", "documents")
both("ops_29_ablation", "WITH j AS (SELECT d.source, d.doc_id, d.n_chars, l.quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id), r AS (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS b FROM j), m AS (SELECT source, min(CASE WHEN quality = 1 THEN a END) AS first_a, min(CASE WHEN quality = 1 THEN b END) AS first_b FROM r GROUP BY source) SELECT source, CASE WHEN first_b IS NULL THEN 'lost' WHEN first_b < first_a THEN 'met' WHEN first_b = first_a THEN 'same' ELSE 'lowered' END AS outcome FROM m", tables="documents labels")


@query("src_05_windows", "SELECT user_id, least(30, greatest(2, ceil(gap / 86400e6)::BIGINT + 1)) AS mail_days, least(43200, ceil(gap / 60e6)::BIGINT) AS jira_minutes, gap > 30 * 86400e6 AS gap_capped FROM (SELECT user_id, (epoch_us(TIMESTAMP '2024-02-10') - epoch_us(max(ts)))::DOUBLE AS gap FROM events GROUP BY user_id)")
def poll_windows(spark, sf_dir):
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("cursor"))
    return captures.poll_windows(newest, "user_id", "cursor", F.lit("2024-02-10 00:00:00").cast("timestamp"))


@query("src_08_issue_events", "SELECT conv_id::VARCHAR AS key, 'issue' AS kind, 'issue-' || conv_id AS id FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id::VARCHAR, 'comment', 'comment-' || conv_id || '-' || turn FROM conversations WHERE turn > 0")
def issue_events(spark, sf_dir):
    """Conversations as nested issues (first turn and its comments), flattened to events again."""
    turns = table(spark, sf_dir, "conversations")
    comments = turns.filter("turn > 0").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("author"), F.col("text").alias("body"))).alias("comments"))
    issues = turns.filter("turn = 0").join(comments, "conv_id", "left").select(F.col("conv_id").cast("string").alias("key"), F.col("role").alias("reporter"), F.col("text").alias("summary"), "comments")
    return captures.issue_events(issues).select("key", "kind", "id")
