"""Queries over fetched pages and over tables that streams keep, on the test tables and on captures written for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.plans.base import query, table
from heronry.scratch import scratch_path
from heronry.sources import listings as L
from heronry.sources import paths as P
from heronry.streaming import tables as G
from heronry.streaming.log import append_log, log_stream, read_log

NOW = "2024-01-20 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


# --- pages -------------------------------------------------------------------------------------------------------------------------


@query("src_10_updated_pulls", "SELECT user_id AS number, epoch_us(max(ts)) AS updated_us FROM events WHERE event_type = 'click' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-20 12:00:00' ORDER BY max(ts), user_id LIMIT 40")
def updated_pulls(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("number"), F.col("ts").alias("updated_at"), (F.col("event_type") == "click").alias("is_pull"))
    return L.updated_pulls(items, _now(), 40).select("number", F.unix_micros("updated_at").alias("updated_us"))


@query("src_10_cursor", "SELECT epoch_us(greatest(TIMESTAMP '2024-01-20 12:00:00', max(ts))) AS cursor_us FROM events WHERE event_type = 'click'")
def cursor(spark, sf_dir):
    read = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("ts").alias("updated_at"))
    return L.next_cursor(read, _now()).select(F.unix_micros("cursor").alias("cursor_us"))


@query("src_11_next_page", "SELECT epoch_us(max(ts) - INTERVAL 1 SECOND) AS since_us, 1 AS page FROM events")
def next_page(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("ts").alias("updated_at"))
    return L.next_page(items, F.lit("2024-01-01").cast("timestamp"), 3, 100).select(F.unix_micros("since").alias("since_us"), "page")


@query("src_12_page_union", "SELECT user_id AS number, arg_min(event_id, (event_id % 13) * 1000000000 + event_id) AS event_id FROM events GROUP BY user_id")
def page_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("number"), "event_id", F.struct((F.col("event_id") % 13).alias("page"), "event_id").alias("page"))
    return L.page_union(rows).select("number", "event_id")


@query(
    "src_14_roster",
    """WITH r AS (SELECT DISTINCT o_custkey AS login, 'committer' AS role FROM orders WHERE o_orderstatus <> 'P' UNION SELECT DISTINCT o_custkey, 'pmc' FROM orders WHERE o_orderstatus = 'P')
    SELECT login, any_value(c_name) AS name, string_agg(role, ',' ORDER BY role) AS roles FROM r LEFT JOIN customer ON c_custkey = login GROUP BY login""",
)
def roster(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    who = lambda test: F.collect_set(F.when(test, F.col("o_custkey")))
    projects = orders.groupBy((F.col("o_orderkey") % 16).alias("project")).agg(who(F.col("o_orderstatus") != "P").alias("members"), who(F.col("o_orderstatus") == "P").alias("owners"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("login"), F.col("c_name").alias("name"))
    return L.roster(projects, people).withColumn("roles", F.array_join("roles", ","))


@query("src_19_changed_pages", "SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'drifted' END AS change FROM pages WHERE page_id % 5 <> 0 OR page_id % 3 = 0")
def changed_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"))
    state = pages.filter("id % 3 <> 0").withColumn("version", F.lit(10))
    step = F.when(F.col("id") % 5 == 0, 0).when(F.col("id") % 3 == 1, 1).otherwise(-1)
    return L.changed_pages(state, pages.withColumn("version", 10 + step))


@query("src_23_key_ranges", "SELECT page_id, CASE WHEN url < 'http://m' THEN 0 WHEN url < 'http://t' THEN 1 ELSE 2 END AS part FROM pages WHERE url >= 'http://'")
def key_ranges(spark, sf_dir):
    ranges = P.key_ranges("http://", ["t", "m"])
    return table(spark, sf_dir, "pages").select("page_id", P.range_of(F.col("url"), ranges).alias("part")).filter("part IS NOT NULL")


@query("src_24_history", "SELECT epoch_us(ts) AS at_us, event_type AS status, count(*) AS n FROM events WHERE user_id % 5 = 2 AND ts >= TIMESTAMP '2024-01-10' GROUP BY ts, event_type ORDER BY ts DESC, event_type LIMIT 20")
def history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("job-"), F.col("user_id") % 5).alias("job"), F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return L.history(rows, "job-2", F.lit("2024-01-10").cast("timestamp")).select(F.unix_micros("at").alias("at_us"), "status", "n")


@query(
    "src_26_usage",
    """SELECT sum(CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-20 12:00:00' THEN k END)::BIGINT AS month, sum(CASE WHEN ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20' THEN k END)::BIGINT AS week,
    sum(CASE WHEN ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' THEN k END)::BIGINT AS day, (SELECT sum(b)::BIGINT FROM (SELECT arg_max(event_id, ts) AS b FROM events GROUP BY event_type)) AS bytes
    FROM (SELECT ts, json_extract(props, '$.k')::BIGINT AS k FROM events)""",
)
def usage(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.get_json_object("props", "$.k").cast("long").alias("requests"), F.col("event_type").alias("bucket"), F.col("event_id").alias("bytes"))
    return L.usage_totals(rows, _now())


# --- streams -----------------------------------------------------------------------------------------------------------------------


def _streamed(spark, parts, schema):
    """The parts as files of a folder, read as a stream of one file a batch."""
    base = scratch_path(spark, "stream")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{base}/in/{i}")
    return base, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")


@query("stm_04_conflicts", "SELECT 'log' AS part, count(*) AS n, round(sum(value), 4) AS total FROM events UNION ALL SELECT 'conflicts', count(*), round(sum(value + 1), 4) FROM events WHERE event_id % 4 = 0")
def conflicts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    other = events.filter("event_id % 4 = 0").withColumn("value", F.col("value") + 1)
    base, stream = _streamed(spark, [events, events.filter("event_id % 3 = 0"), other], events.schema)
    G.append_checked(stream, f"{base}/out", "event_id", f"{base}/progress")
    total = lambda name: G.read_part(spark, f"{base}/out", name, ["event_id", "value"]).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.lit(name).alias("part"), "n", "total")
    return total("log").unionByName(total("conflicts"))


@query("stm_09_upserts", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upserts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    parts = [events.filter(F.col("event_id") % 3 == k) for k in (2, 0, 1)]
    base, stream = _streamed(spark, parts, events.schema)
    G.keep_current(stream, f"{base}/current", "user_id", ["ts", "event_id"], f"{base}/progress")
    kept = G.current_rows(spark, f"{base}/current")
    return (events if kept is None else kept).select("user_id", "event_id", "event_type")


@query("stm_10_replay", "SELECT event_id FROM events")
def replay(spark, sf_dir):
    """The log after a stop in the middle, a restart and a repeat of what had been sent: the rows of one clean run."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = scratch_path(spark, "replay")
    for name, part in (("a", events.filter("event_id % 2 = 0")), ("b", events)):
        part.write.parquet(f"{base}/in/{name}")
        append_log(log_stream(spark, f"{base}/in/*", events.schema, "ts", ["event_id"]), f"{base}/log", f"{base}/progress")
    return read_log(spark, f"{base}/log").select("event_id")


@query("stm_02_cursors", "SELECT event_type AS source, epoch_us(greatest(TIMESTAMP '2024-01-15', max(ts) FILTER (event_type <> 'error'))) AS cursor_us FROM events GROUP BY event_type")
def cursors(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.select(F.col("event_type").alias("source")).distinct().withColumn("cursor", F.lit("2024-01-15").cast("timestamp"))
    polled = events.select(F.col("event_type").alias("source"), F.col("ts").alias("read_at"), (F.col("event_type") != "error").alias("ok"))
    return G.merged_cursors(old, polled).select("source", F.unix_micros("cursor").alias("cursor_us"))


@query("stm_08_rolling", "SELECT event_type, count_if(ts BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00') AS week, count_if(ts BETWEEN TIMESTAMP '2024-01-19 12:00:00' AND TIMESTAMP '2024-01-20 12:00:00') AS day FROM events GROUP BY event_type")
def rolling(spark, sf_dir):
    return G.rolling_counts(table(spark, sf_dir, "events"), "event_type", "ts", _now(), {"week": 7, "day": 1})


@query(
    "stm_05_parents",
    """WITH n AS (SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    y AS (SELECT * FROM n WHERE ts >= TIMESTAMP '2024-01-20 12:00:00')
    SELECT user_id, event_id FROM n WHERE user_id IN (SELECT user_id FROM y) OR user_id IN (SELECT user_id // 2 FROM y)""",
)
def parents(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr("user_id DIV 2").alias("parent"))
    return G.compacted(rows, "user_id", "parent", "ts", F.lit(NOW).cast("timestamp") + F.expr("interval 35 days")).select("user_id", "event_id")
