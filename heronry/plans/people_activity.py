"""Activity of people, threads and sources over the test tables: each query applies an operator, its twin states the rule as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.operators import activity as A
from heronry.plans.base import query, table

col = F.col


def at(day: str):
    return F.lit(day).cast("timestamp")


def tables(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in names.split()}


@query("win_03_running_count", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS k FROM events")
def running_count(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.numbered(t["events"], "user_id", ["ts", "event_id"], "k").select("event_id", "k")


@query("win_05_first_appearance", "SELECT event_type, CAST(row_number() OVER (ORDER BY first_id) AS BIGINT) AS place FROM (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type) f")
def first_appearance(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.first_appearance(t["events"], "event_type", "event_id")


@query("win_06_cut_value", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(CASE WHEN rn = least(20, n) THEN value END) AS cut FROM r GROUP BY user_id")
def cut_value(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.cut_value(t["events"], "user_id", "value", "event_id", 20)


@query("win_07_gap", "SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap_us FROM events")
def gap(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.gaps(t["events"], "user_id", "ts", "event_id")


@query("win_08_leading_prefix", "WITH m AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS stops FROM conversations) SELECT conv_id, CAST(sum(CASE WHEN stops = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leading FROM m GROUP BY conv_id")
def leading_prefix(spark, sf_dir):
    t = tables(spark, sf_dir, "conversations")
    return A.leading(t["conversations"], "conv_id", "turn", col("role") == "assistant")


@query("win_11_previous_runs", "WITH p AS (SELECT event_id, value, count(*) OVER w AS n, avg(value) OVER w AS mean_before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT event_id, n, round(mean_before, 5) AS mean_before, n >= 3 AND value > 2 * mean_before AS slow FROM p")
def previous_runs(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.slow_runs(t["events"], "event_type", ["ts", "event_id"], "value", "event_id").withColumn("mean_before", F.round("mean_before", 5))


@query("win_15_first_last", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def first_last(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.ends(t["events"], "user_id", "event_id", "event_type").withColumnsRenamed({"first": "first_type", "last": "last_type"})


@query("agg_07_activity_score", "SELECT user_id, count(*) AS score, array_to_string(list_sort(list(event_id)), ',') AS evidence FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31' AND event_type <> 'error' GROUP BY user_id")
def activity_score(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.activity_score(t["events"], "user_id", "ts", "event_id", at("2024-01-24"), at("2024-01-31"), col("event_type") != "error").withColumn("evidence", F.array_join("evidence", ","))


@query("agg_09_newest_lag", "WITH n AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id) SELECT user_id, CAST(newest AS DATE) AS newest_day, newest < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY AS lagging FROM n")
def newest_lag(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.newest_lag(t["events"], "user_id", "ts", at("2024-01-31"), 1).select("user_id", F.to_date("newest").alias("newest_day"), "lagging")


@query("agg_10_topic_mix", "SELECT topic, count(*) AS threads FROM (SELECT CASE WHEN lower(text) LIKE '%license%' THEN 'card' WHEN lower(text) LIKE '%the%' THEN 'routine' ELSE 'uncategorized' END AS topic FROM documents) t GROUP BY topic")
def topic_mix(spark, sf_dir):
    t = tables(spark, sf_dir, "documents")
    return A.topic_mix(t["documents"], "text", [("card", "license"), ("routine", "the")], "uncategorized")


@query("agg_13_stage_counts", "SELECT o_orderstatus AS stage, count(*) AS threads, count(DISTINCT o_custkey) AS people, CAST(max(o_orderdate) AS DATE) AS newest FROM orders GROUP BY o_orderstatus")
def stage_counts(spark, sf_dir):
    t = tables(spark, sf_dir, "orders")
    return A.stage_counts(t["orders"], "o_orderstatus", "o_custkey", "o_orderdate").withColumn("newest", F.to_date("newest"))


@query("agg_14_verdict_memory", "WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM s WHERE event_type = 'error') SELECT user_id, event_id, before AS verdict_before FROM r WHERE rn = 1")
def verdict_memory(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.verdict_memory(t["events"], "user_id", ["ts", "event_id"], "event_id", "event_type", "error")


@query("agg_16_month_merge", "WITH i AS (SELECT event_id, value + 1 AS value FROM events WHERE event_type = 'click'), u AS (SELECT event_id, value, 1 AS newer FROM i UNION ALL SELECT event_id, value, 0 AS newer FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY newer DESC) AS rn FROM u) SELECT event_id, round(value, 4) AS value FROM r WHERE rn = 1")
def month_merge(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.newer_wins(t["events"].select("event_id", "value"), t["events"].filter("event_type = 'click'").select("event_id", (col("value") + 1).alias("value")), "event_id").withColumn("value", F.round("value", 4))


@query("agg_17_month_summary", "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) FILTER (WHERE event_type = 'signup') AS opened, count(*) FILTER (WHERE event_type = 'purchase') AS merged, count(*) FILTER (WHERE event_type = 'click') AS commented, count(DISTINCT CASE WHEN event_type = 'view' THEN ts::DATE END) AS view_days, max(ts)::DATE AS last_day FROM events GROUP BY 1, 2")
def month_summary(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.month_summary(t["events"], "user_id", "ts", "event_type", {"opened": "signup", "merged": "purchase", "commented": "click"}, "view")


@query("agg_19_given_received", "WITH p AS (SELECT DISTINCT c_nationkey AS giver, s_nationkey AS receiver, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey), g AS (SELECT giver AS nation, count(*) AS given FROM p GROUP BY giver), r AS (SELECT receiver AS nation, count(*) AS received FROM p GROUP BY receiver) SELECT coalesce(g.nation, r.nation) AS nation, coalesce(given, 0) AS given, coalesce(received, 0) AS received FROM g FULL JOIN r ON g.nation = r.nation")
def given_received(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem orders customer supplier")
    return A.given_received(t["lineitem"].join(t["orders"], col("l_orderkey") == col("o_orderkey")).join(t["customer"], col("o_custkey") == col("c_custkey")).join(t["supplier"], col("l_suppkey") == col("s_suppkey")), "c_nationkey", "s_nationkey", "l_orderkey", "nation")


@query("agg_28_coverage", "SELECT d.source, count(DISTINCT d.doc_id) AS total, count(DISTINCT l.doc_id) AS covered FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def coverage(spark, sf_dir):
    t = tables(spark, sf_dir, "documents labels")
    return A.coverage(t["documents"], "source", "doc_id", t["labels"])


@query("agg_29_starter", "WITH f AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('signup', 'click')) SELECT event_type, user_id AS starter, event_id FROM f WHERE rn = 1")
def starter(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.starters(t["events"].filter("event_type IN ('signup', 'click')"), "event_type", "user_id", ["ts", "event_id"])


@query("agg_32_vote_tally", "WITH v AS (SELECT user_id % 20 AS topic, user_id, event_type, row_number() OVER (PARTITION BY user_id % 20, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('view', 'purchase', 'error')), t AS (SELECT topic, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS plus_one, count(CASE WHEN event_type = 'error' THEN 1 END) AS minus_one, count(CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 1 END) AS binding FROM v WHERE rn = 1 GROUP BY topic) SELECT topic, plus_one, minus_one, binding, CASE WHEN minus_one > 0 AND minus_one >= plus_one THEN 'vetoed' WHEN binding >= 3 AND plus_one > minus_one THEN 'passing' ELSE 'open' END AS state FROM t")
def vote_tally(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.vote_tally(t["events"].filter("event_type IN ('view', 'purchase', 'error')").select((col("user_id") % 20).alias("topic"), "user_id", "ts", "event_id", "event_type", (col("user_id") % 2 == 0).alias("member")), "topic", "user_id", ["ts", "event_id"], "event_type", "member", "purchase", "error")


@query("agg_36_longest_waits", "WITH w AS (SELECT o_orderstatus, o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS days FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY days DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM w) SELECT o_orderstatus, o_orderkey, days, total FROM r WHERE rn <= 3")
def longest_waits(spark, sf_dir):
    t = tables(spark, sf_dir, "orders")
    return A.longest_waits(t["orders"], "o_orderstatus", "o_orderkey", F.date_diff(F.lit("1999-01-01").cast("date"), F.to_date("o_orderdate")).cast("long"), 3)


@query("agg_37_review_state", "SELECT o_orderkey, count(DISTINCT l_suppkey) AS reviewers, CAST(max(l_shipdate) AS DATE) AS last_review, CASE WHEN max(l_shipdate) IS NULL THEN 'waiting' WHEN max(l_shipdate) > max(o_orderdate) + INTERVAL 90 DAY THEN 'author' ELSE 'reviewer' END AS clock FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def review_state(spark, sf_dir):
    t = tables(spark, sf_dir, "orders lineitem")
    return A.review_clock(t["orders"], t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "o_orderdate", "l_suppkey", "l_shipdate", 90)


@query("agg_45_count_line", "SELECT source, concat(CAST(count(*) AS VARCHAR), CASE WHEN count(*) = 1 THEN ' result' ELSE ' results' END, CASE WHEN count(*) > 20 THEN ', 20 shown' ELSE '' END) AS line FROM documents GROUP BY source")
def count_line(spark, sf_dir):
    t = tables(spark, sf_dir, "documents")
    return t["documents"].groupBy("source").agg(A.count_line(F.count("*"), 20).alias("line"))


@query("agg_48_run_counts", "SELECT source, count(*) AS entries, count(CASE WHEN n_chars < 200 THEN 1 END) AS rejected, CASE WHEN count(CASE WHEN n_chars < 200 THEN 1 END) = 0 THEN 'complete' WHEN count(CASE WHEN n_chars < 200 THEN 1 END) = count(*) THEN 'failed' ELSE 'partial' END AS status FROM documents GROUP BY source")
def run_counts(spark, sf_dir):
    t = tables(spark, sf_dir, "documents")
    return A.run_counts(t["documents"], "source", col("n_chars") < 200)


@query("agg_50_auc", "WITH j AS (SELECT quality, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT n_chars, count(*) AS n, sum(quality) AS pos FROM j GROUP BY n_chars), r AS (SELECT pos, n - pos AS neg, coalesce(sum(n - pos) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(pos * (below + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 5) AS auc FROM r")
def auc(spark, sf_dir):
    t = tables(spark, sf_dir, "labels documents")
    return A.auc(t["labels"].join(t["documents"], "doc_id"), "quality", "n_chars").select(F.round("auc", 5).alias("auc"))


@query("joi_02_missing_parent", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.event_id)")
def missing_parent(spark, sf_dir):
    t = tables(spark, sf_dir, "labels events")
    return A.missing(t["events"].select("event_id"), "event_id", t["labels"], "doc_id")


@query("joi_09_newer_wins", "SELECT coalesce(i.doc_id, s.doc_id) AS doc_id, coalesce(i.v, s.v) AS v FROM (SELECT doc_id, n_chars AS v FROM documents) s FULL JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS v FROM labels) i ON s.doc_id = i.doc_id")
def newer_wins(spark, sf_dir):
    t = tables(spark, sf_dir, "documents labels")
    return A.newer_wins(t["documents"].select("doc_id", col("n_chars").alias("v")), t["labels"].select("doc_id", col("quality").cast("long").alias("v")), "doc_id")


@query("joi_10_fingerprint", "SELECT a.doc_id, b.doc_id AS first_id FROM (SELECT doc_id, substring(sha256(text), 1, 32) AS f FROM documents) a JOIN (SELECT substring(sha256(text), 1, 32) AS f, min(doc_id) AS doc_id FROM documents GROUP BY 1) b ON a.f = b.f")
def fingerprint(spark, sf_dir):
    t = tables(spark, sf_dir, "documents")
    return A.first_of_equal(t["documents"], "doc_id", col("text")).withColumnRenamed("first", "first_id")


@query("joi_17_latest_of_two", "WITH a AS (SELECT user_id, max(event_id) AS discussed FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, max(event_id) AS voted FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN voted IS NULL OR discussed > voted THEN 'discuss' ELSE 'vote' END AS stage FROM a FULL JOIN b ON a.user_id = b.user_id")
def latest_of_two(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.later_of_two(t["events"].filter("event_type = 'view'"), t["events"].filter("event_type = 'purchase'"), "user_id", "event_id", ("discuss", "vote"))


@query("set_04_keep_first", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) t WHERE rn = 1")
def keep_first(spark, sf_dir):
    t = tables(spark, sf_dir, "documents")
    return A.kept_first(t["documents"], "text", "doc_id", ["lang"])


@query("set_07_equal_ids", "SELECT count(*) = 0 AS equal FROM ((SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) d")
def equal_ids(spark, sf_dir):
    t = tables(spark, sf_dir, "orders lineitem")
    return A.same_keys(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey")


@query("set_09_unique_both", "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS a, count(*) OVER (PARTITION BY l_partkey) AS b FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) d) c WHERE a = 1 AND b <= 30")
def unique_both(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem")
    return A.sparse_pairs(t["lineitem"], "l_orderkey", "l_partkey", 1, 30)


@query("fil_03_status_groups", "SELECT e.event_id FROM events e JOIN (SELECT user_id FROM events GROUP BY user_id HAVING count(CASE WHEN event_type = 'purchase' THEN 1 END) >= 5) g ON e.user_id = g.user_id")
def status_groups(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.in_busy_groups(t["events"], "user_id", col("event_type") == "purchase", 5).select("event_id")


@query("fil_20_invariants", "SELECT conv_id, count(*) <> count(DISTINCT turn) AS repeated, min(turn) <> 0 OR max(turn) <> count(*) - 1 AS gaps FROM conversations GROUP BY conv_id")
def invariants(spark, sf_dir):
    t = tables(spark, sf_dir, "conversations")
    return A.sequence_issues(t["conversations"], "conv_id", "turn")


@query("srt_06_timeline", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS BIGINT) AS place FROM events")
def timeline(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.numbered(t["events"], "user_id", [F.desc("ts"), "event_id"], "place").select("event_id", "place")


@query("ops_01_trend", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1), h AS (SELECT day, n, errors, avg(n) OVER w AS usual, count(*) OVER w AS history FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) SELECT day, n, errors, CASE WHEN history < 3 THEN 'no_history' WHEN n < 0.5 * usual THEN 'drop' WHEN n > 1.5 * usual THEN 'spike' ELSE 'ok' END AS status FROM h")
def trend(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.trend(t["events"], "ts", col("event_type") == "error")


@query("ops_03_worst_status", "SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) WHEN 2 THEN 'red' WHEN 1 THEN 'yellow' ELSE 'green' END AS status FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY user_id")
def worst_status(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.worst_status(t["events"].filter("ts >= '2024-01-25'"), "user_id", [(col("event_type") == "error", "red"), (col("event_type") == "purchase", "yellow")], "green")


@query("ops_07_diagnosis_plan", "WITH f AS (SELECT CAST(ts AS DATE) AS day, user_id, min(event_id) AS first_id, count(*) AS firings FROM events WHERE event_type = 'error' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY first_id) AS rn FROM f) SELECT day, user_id, first_id, firings FROM r WHERE rn <= 5")
def diagnosis_plan(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.diagnosis_plan(t["events"].filter("event_type = 'error'"), "ts", "user_id", "event_id", 5)


@query("ops_09_volume_cap", "SELECT event_type, count(*) AS n, round(count(*) / CAST(500 AS DOUBLE), 4) AS share, count(*) > 500 AS over_cap FROM events GROUP BY event_type")
def volume_cap(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.volume_cap(t["events"], "event_type", 500)


@query("agg_27_areas_with_other", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rn FROM c) SELECT CASE WHEN rn <= 6 THEN source ELSE 'other' END AS area, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def areas_with_other(spark, sf_dir):
    t = tables(spark, sf_dir, "documents")
    return A.with_other(t["documents"], "source", 6, "area")


@query("agg_23_works_with", "WITH p AS (SELECT DISTINCT o_custkey, l_suppkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT o_custkey, l_suppkey, count(*) AS n FROM p GROUP BY o_custkey, l_suppkey), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_suppkey) AS rn FROM c) SELECT o_custkey, l_suppkey, n FROM r WHERE rn <= 10")
def works_with(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem orders")
    return A.work_with(t["lineitem"].join(t["orders"], col("l_orderkey") == col("o_orderkey")), "o_custkey", "l_suppkey", "l_partkey", 10)


@query("set_11_missing_days", "SELECT day::DATE AS day FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS day) WHERE day::DATE NOT IN (SELECT ts::DATE FROM events)")
def missing_days(spark, sf_dir):
    t = tables(spark, sf_dir, "events")
    return A.missing_days(t["events"], "ts", "2023-12-25", "2024-02-05")
