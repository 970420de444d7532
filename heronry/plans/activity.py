"""Queries over logs, threads, people and calendars, each one SQL statement and its twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import records as R
from heronry.plans.base import both, query, table

# --- windows -----------------------------------------------------------------------------------------------------------------


# --- aggregations ------------------------------------------------------------------------------------------------------------

both("agg_22_over_time", "WITH m AS (SELECT explode(sequence(DATE '2023-11-27', DATE '2024-02-05', INTERVAL 7 DAYS)) AS week), t AS (SELECT DISTINCT event_type FROM {events}), n AS (SELECT CAST(date_trunc('WEEK', ts) AS DATE) AS week, event_type, count(*) AS n FROM {events} GROUP BY 1, 2) SELECT m.week, t.event_type, CASE WHEN m.week >= DATE '2024-01-01' THEN coalesce(n.n, 0) END AS n FROM m CROSS JOIN t LEFT JOIN n ON n.week = m.week AND n.event_type = t.event_type", "WITH m AS (SELECT unnest(generate_series(DATE '2023-11-27', DATE '2024-02-05', INTERVAL 7 DAY))::DATE AS week), t AS (SELECT DISTINCT event_type FROM {events}), n AS (SELECT date_trunc('week', ts)::DATE AS week, event_type, count(*) AS n FROM {events} GROUP BY 1, 2) SELECT m.week, t.event_type, CASE WHEN m.week >= DATE '2024-01-01' THEN coalesce(n.n, 0) END AS n FROM m CROSS JOIN t LEFT JOIN n ON n.week = m.week AND n.event_type = t.event_type", "events")
both("agg_24_thread_list", "SELECT l_suppkey, l_orderkey, count(*) AS rows_in_thread, substring(max(concat(lpad(CAST(l_linenumber AS STRING), 3, '0'), l_linestatus)), 4, 1) AS latest_state, count(DISTINCT l_partkey) AS partners FROM {lineitem} GROUP BY l_suppkey, l_orderkey", tables="lineitem")
both("agg_51_peak_bucket", "WITH n AS (SELECT CAST(date_trunc('WEEK', ts) AS DATE) AS week, count(*) AS n FROM {events} GROUP BY 1), p AS (SELECT CAST(max(n) AS DOUBLE) AS peak FROM n), s AS (SELECT peak, peak / 4 / power(10.0, floor(log10(peak / 4))) AS m, power(10.0, floor(log10(peak / 4))) AS ten FROM p) SELECT CAST(peak AS BIGINT) AS peak, CAST(ten * CASE WHEN m <= 1 THEN 1 WHEN m <= 2 THEN 2 WHEN m <= 5 THEN 5 ELSE 10 END AS BIGINT) AS step FROM s", tables="events")

# --- joins -------------------------------------------------------------------------------------------------------------------

both("joi_04_bidirectional", "SELECT nation, count(DISTINCT other) AS neighbours FROM (SELECT a.n_nationkey AS nation, b.n_nationkey AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey UNION ALL SELECT b.n_nationkey AS nation, a.n_nationkey AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) p GROUP BY nation", tables="nation")
both("joi_15_anti_pair", "WITH p AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM {customer} JOIN {supplier} ON c_custkey = s_suppkey) SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM {nation} x JOIN {nation} y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey LEFT JOIN p ON p.a = x.n_nationkey AND p.b = y.n_nationkey WHERE p.a IS NULL", tables="customer supplier nation")
both("joi_20_left_null", "SELECT c_custkey, n FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey", tables="customer orders")
both("joi_21_lower_key", "SELECT n_name, r_name FROM {nation} JOIN {region} ON lower(n_name) = lower(concat('Nation_', r_regionkey))", tables="nation region")


@query("joi_24_top_three", "WITH p AS (SELECT a.p_partkey AS x, b.p_partkey AS y, abs(a.p_retailprice - b.p_retailprice) AS gap FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY gap, y) AS rn FROM p) SELECT x, y, round(gap, 4) AS gap FROM r WHERE rn <= 3")
def top_three(spark, sf_dir):
    rows = R.nearest_by_value(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"], "p_retailprice", 3)
    return rows.select("x", "y", F.round("gap", 4).alias("gap"))



# --- sets --------------------------------------------------------------------------------------------------------------------

both("set_08_unseen", "SELECT event_id FROM {events} e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'signup' AND event_id % 7 = 0) s WHERE s.user_id = e.user_id)", tables="events")
both("set_12_stale_vectors", "SELECT vec_id FROM {embeddings} EXCEPT SELECT doc_id FROM {documents}", tables="embeddings documents")

# --- filters, orders, dates, text --------------------------------------------------------------------------------------------

both("fil_04_closed_window", "SELECT event_id FROM {events} WHERE ts BETWEEN TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-30 00:00:00'", tables="events")
both("fil_14_suppressed", "SELECT c_custkey, CASE WHEN substring(sha2(c_name, 256), 1, 1) = '0' THEN NULL ELSE c_name END AS shown FROM {customer}", "SELECT c_custkey, CASE WHEN substring(sha256(c_name), 1, 1) = '0' THEN NULL ELSE c_name END AS shown FROM {customer}", "customer")
both("srt_12_person_merge", "SELECT c_custkey, CAST(place AS BIGINT) AS place FROM (SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_name LIKE '%1' THEN 0 ELSE 1 END, c_name, c_custkey) AS place FROM {customer} WHERE c_name LIKE '%1%') t WHERE place <= 3", tables="customer")
both("dat_06_bucket_bounds", "SELECT DISTINCT CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS first_day, CAST(add_months(date_trunc('MONTH', o_orderdate), 1) AS DATE) AS end_day FROM {orders}", "SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS first_day, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS end_day FROM {orders}", "orders")
both("dat_09_month_fraction", "SELECT event_id, round(CAST(unix_micros(ts) - unix_micros(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) / (31 * 86400e6), 6) AS elapsed, 31 - day(ts) AS remaining FROM {events}", "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / (31 * 86400e6), 6) AS elapsed, (31 - day(ts))::INT AS remaining FROM {events}", "events")
both("dat_11_freshness", "SELECT user_id, CASE WHEN newest >= TIMESTAMP '2024-01-30 00:00:00' THEN 'fresh' WHEN newest >= TIMESTAMP '2024-01-28 00:00:00' THEN 'overdue' ELSE 'stale' END AS state FROM (SELECT user_id, max(ts) AS newest FROM {events} GROUP BY user_id) n", tables="events")
both("dat_14_day_number", "SELECT event_id, CAST(unix_micros(ts) AS BIGINT) DIV 86400000000 AS day_number FROM {events}", "SELECT event_id, epoch_us(ts) // 86400000000 AS day_number FROM {events}", "events")
both("mat_02_idf", "WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {documents}), f AS (SELECT source, CAST(count(*) AS DOUBLE) AS df FROM {documents} GROUP BY source) SELECT source, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f CROSS JOIN n", tables="documents")
both("mat_10_projection", "WITH s AS (SELECT event_type, sum(value) AS spent FROM {events} WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type) SELECT event_type, round(spent * 31.0 / 19.0, 3) AS projected FROM s", tables="events")
both("mat_14_backoff", "SELECT user_id, least(24 * CAST(power(2.0, least(failures, 10)) AS BIGINT), 720) AS hours FROM (SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS failures FROM {events} GROUP BY user_id) f", tables="events")
both("str_22_blurb", "SELECT doc_id, CASE WHEN length(text) <= 180 THEN text ELSE regexp_extract(substring(text, 1, 180), '(?s)^(.*) [^ ]*$', 1) END AS blurb FROM {documents} WHERE text IS NOT NULL", tables="documents")
both("jsn_07_refs", "SELECT doc_id, base64(encode(concat(source, ':', CAST(doc_id AS STRING)), 'UTF-8')) AS ref FROM {documents}", "SELECT doc_id, base64(encode(concat(source, ':', CAST(doc_id AS VARCHAR)))) AS ref FROM {documents}", "documents")
