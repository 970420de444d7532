"""Queries over polls, keyed state with timers, a latched breaker and hooks, each run as a stream over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.plans.base import query, table
from heronry.scratch import scratch_path
from heronry.sources import cursor as C
from heronry.streaming import hooks as H
from heronry.streaming import progress as P
from heronry.streaming import publication as B
from heronry.streaming import tables as G

#: Least partitions of the state of these queries; as many as the session runs tasks at once where keys grow with the tables.
STATE_PARTITIONS = 4


@query("stm_01_cursor_source", "SELECT event_id AS id, epoch_us(ts) AS updated_us FROM events")
def cursor_source(spark, sf_dir):
    """The log after as many polls as it takes, each a run of its own that goes on from the checkpoint; every poll has more before it than it takes."""
    base = scratch_path(spark, "polls")
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.unix_micros("ts").alias("updated_us"), F.col("props").alias("body"))
    items.sort("updated_us").write.parquet(f"{base}/listing")
    newest, total = items.agg(F.max("updated_us"), F.count("*")).first()
    for _ in range(4):
        stream = C.polled(spark, f"{base}/listing", 0, -(-total // 3))
        G.append_checked(stream, f"{base}/out", "id", f"{base}/progress")
        if G.read_part(spark, f"{base}/out", "log", ["updated_us"]).agg(F.max("updated_us")).first()[0] == newest:
            break
    return G.read_part(spark, f"{base}/out", "log", ["id", "updated_us"])


def _files(spark, base: str, parts: list):
    """The parts as files of one folder, read one a batch in this order."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{base}/in/{i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")


OUTCOMES = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'absent' WHEN 'signup' THEN 'forgotten' ELSE 'done' END"


@query(
    "stm_13_progress",
    f"""WITH a AS (SELECT vec_id AS key, ts, event_id, {OUTCOMES} AS outcome FROM events JOIN embeddings ON vec_id = user_id),
    r AS (SELECT *, count_if(outcome IN ('done', 'forgotten')) OVER w AS part FROM a WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
    l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS back, count_if(outcome = 'failed') OVER p AS failures,
            min(CASE WHEN outcome = 'absent' THEN ts END) OVER p AS absent, arg_max(CASE WHEN outcome = 'done' THEN event_id::VARCHAR END, (ts, event_id)) FILTER (outcome IN ('done', 'forgotten')) OVER p AS mark, count(*) OVER (PARTITION BY key) AS attempts
          FROM r WINDOW p AS (PARTITION BY key, part))
    SELECT key, outcome AS status, mark, failures::INT AS failures, attempts, epoch_us(absent) AS absent_us,
           CASE WHEN outcome = 'failed' THEN epoch_us(ts) // 1000 + 3600000 * least(24 * 2 ** (failures - 1), 720)::BIGINT END AS retry_ms FROM l WHERE back = 1""",
)
def progress(spark, sf_dir):
    """Attempts to embed the vectors in three files, the first of them once more at the end: the last state of each vector."""
    base, events = scratch_path(spark, "progress"), table(spark, sf_dir, "events")
    outcome = F.expr(OUTCOMES)
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("user_id"))
    attempts = events.join(known, "user_id", "left_semi").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.unix_micros("ts").alias("at_us"), F.col("event_id").alias("number"), outcome.alias("outcome"), F.col("event_id").cast("string").alias("mark"))
    cuts = ["2024-01-01", "2024-01-10", "2024-01-20", "2025-01-01"]
    parts = [attempts.filter((F.col("at") >= a) & (F.col("at") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    P.track(_files(spark, base, [*parts, parts[0]]), f"{base}/out", f"{base}/checkpoint", "400 days", max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))
    last = P.changes(spark, f"{base}/out", P.PROGRESS).filter("NOT due").groupBy("key").agg(F.max_by(F.struct("status", "mark", "failures", "attempts", "absent_us", "retry_ms"), "attempts").alias("s"))
    return last.select("key", "s.*")


@query(
    "ops_05_latched_breaker",
    """WITH m AS (SELECT event_type AS scope, epoch_us(ts) AS at_us, CASE WHEN event_id % 2 = 0 THEN 'spike' ELSE 'budget' END AS metric, value, CASE WHEN event_id % 2 = 0 THEN 75.0 ELSE 70.0 END AS threshold FROM events),
    o AS (SELECT * FROM m WHERE value >= threshold),
    f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY scope ORDER BY at_us, metric DESC) = 1),
    s AS (SELECT scope, string_agg(metric, ',' ORDER BY first_at) AS metrics FROM (SELECT scope, metric, min(at_us) AS first_at FROM o GROUP BY 1, 2) GROUP BY scope)
    SELECT scope, metric, value, threshold, at_us AS opened_us, metrics FROM f JOIN s USING (scope)""",
)
def latched_breaker(spark, sf_dir):
    base, events = scratch_path(spark, "breaker"), table(spark, sf_dir, "events")
    spike = F.col("event_id") % 2 == 0
    measured = events.select(F.col("event_type").alias("scope"), F.unix_micros("ts").alias("at_us"), F.when(spike, "spike").otherwise("budget").alias("metric"), "value", F.when(spike, 75.0).otherwise(70.0).alias("threshold"))
    middle = F.lit("2024-01-15").cast("timestamp")
    parts = [measured.filter(F.col("at_us") < F.unix_micros(middle)), measured.filter(F.col("at_us") >= F.unix_micros(middle))]
    P.guard(_files(spark, base, parts), f"{base}/out", f"{base}/checkpoint", STATE_PARTITIONS)
    newest = P.changes(spark, f"{base}/out", P.BREAKER).groupBy("scope").agg(F.max_by(F.struct("metric", "value", "threshold", "opened_us", "metrics"), F.size(F.split("metrics", ","))).alias("s"))
    return newest.select("scope", "s.*")


@query("stm_14_hook", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'told ok', count(*) FROM events")
def hook(spark, sf_dir):
    """Rows of the published table by type, and those that a hook after each batch was told of."""
    base, events = scratch_path(spark, "hook"), table(spark, sf_dir, "events").select("event_id", "event_type")
    parts = [events.filter(F.col("event_id") % 3 == k) for k in range(3)]
    outcomes = H.run_with_hook(_files(spark, base, parts), f"{base}/out", f"{base}/checkpoint", f"hook-{base[-32:]}", lambda status: None)
    told = spark.createDataFrame([(f"told {outcome}", rows) for _, rows, outcome in outcomes], "event_type string, n long")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n")).unionByName(told.groupBy("event_type").agg(F.sum("n").alias("n")))


@query("stm_03_published_batches", "SELECT user_id, count(*) AS n, max(event_id) AS newest FROM events GROUP BY user_id")
def published_batches(spark, sf_dir):
    """The release that stands after three batches, each published before it was committed."""
    base, events = scratch_path(spark, "publication"), table(spark, sf_dir, "events").select("user_id", "event_id")
    stream = _files(spark, base, [events.filter(F.col("event_id") % 3 == k) for k in range(3)])
    B.publish_batches(stream, base, "user_id", f"{base}/progress", lambda log: log.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest")))
    return B.published(spark, base)
