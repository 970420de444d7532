"""Queries over link paths, what a store keeps, and releases that are read while others are published."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import paths as P
from heronry.operators import retention as K
from heronry.plans.base import query, table
from heronry.scratch import scratch_path
from heronry.sources import pinned as N

# --- paths: users are identities; the users of an event of high value and of the event before it are linked ---------------------------

LINKS = """l AS (SELECT least(e.user_id, p.user_id) AS a, greatest(e.user_id, p.user_id) AS b, min(e.event_type) AS basis
  FROM events e JOIN events p ON p.event_id = e.event_id - 1 WHERE e.value > 60 AND e.user_id <> p.user_id GROUP BY 1, 2),
w AS (SELECT a AS f, {'a': a, 'b': b, 'basis': basis, 'to': b} AS step FROM l UNION ALL SELECT b, {'a': a, 'b': b, 'basis': basis, 'to': a} FROM l),
s AS (SELECT event_type AS page, user_id AS id, min(event_id) AS rank FROM events WHERE event_id < 12 GROUP BY 1, 2),
d AS (SELECT page, id, min(depth) AS depth FROM reached GROUP BY 1, 2)"""
REACHED = "reached(page, id, depth) AS (SELECT page, id, 0 FROM s UNION SELECT page, step.to, depth + 1 FROM reached JOIN w ON w.f = reached.id WHERE depth < 30)"
WAYS = """ways(page, id, depth, rank, path) AS (SELECT page, id, 0, rank, CAST([] AS STRUCT(a BIGINT, b BIGINT, basis VARCHAR, "to" BIGINT)[]) FROM s UNION ALL
  SELECT page, step.to, any_value(ways.depth) + 1, min({'rank': rank, 'path': list_append(path, step)}).rank, min({'rank': rank, 'path': list_append(path, step)}).path
  FROM ways JOIN w ON w.f = ways.id JOIN d USING (page) WHERE d.id = step.to AND d.depth = ways.depth + 1 GROUP BY page, step.to)"""
_PARTS = LINKS.split(",\nd AS ")


@query(
    "joi_16_link_paths",
    f"WITH RECURSIVE {_PARTS[0]}, {REACHED}, d AS {_PARTS[1]}, {WAYS} SELECT page, id, depth, array_to_string(list_transform(path, lambda x: x.basis || ':' || x.to), '>') AS path FROM ways",
)
def link_paths(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    before = events.select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("other"))
    met = events.filter("value > 60").join(before, "event_id").filter("user_id <> other")
    links = met.groupBy(F.least("user_id", "other").alias("a"), F.greatest("user_id", "other").alias("b")).agg(F.min("event_type").alias("basis"))
    starts = events.filter("event_id < 12").select(F.col("event_type").alias("page"), F.col("user_id").alias("id"), F.col("event_id").alias("rank"))
    told = P.shortest_paths(starts, links)
    return told.select("page", "id", "depth", F.array_join(F.transform("path", lambda x: F.concat(x["basis"], F.lit(":"), x["to"].cast("string"))), ">").alias("path"))


# --- retention: each day of events is a publication set with a feed and a search release; users are objects of the days they act on ---

NOW = "2024-02-10 00:00:00"
STORE = """t AS (SELECT DISTINCT strftime(ts, '%Y%m%dT000000Z') AS token, date_trunc('day', ts) AS born FROM events),
e AS (SELECT CASE WHEN day(born) = 13 THEN 'set-first' ELSE 'set-' || token END AS set_id, CASE WHEN day(born) = 13 THEN NULL ELSE born END AS born, token FROM t),
n AS (SELECT set_id FROM e WHERE born IS NOT NULL ORDER BY born DESC LIMIT 2),
p AS (SELECT * FROM (VALUES ('feed', 'feed-20240130T000000Z', 'pointer'), ('search', 'search-20240129T000000Z', 'pointer'), ('feed', 'feed-20240105T000000Z', 'digest')) v(projection, release, reason)),
k AS (SELECT set_id, token, CASE WHEN born IS NULL THEN 'untimed' WHEN born > TIMESTAMP '2024-01-11' THEN 'window' WHEN set_id IN (SELECT set_id FROM n) THEN 'floor'
  WHEN EXISTS (SELECT 1 FROM p WHERE contains(p.release, e.token)) THEN 'pinned' END AS reason FROM e)"""
RELEASES = f"""{STORE},
r AS (SELECT projection, projection || '-' || token AS release, token, born AS made FROM t, (VALUES ('feed'), ('search')) v(projection)),
x AS (SELECT projection, release, reason FROM p UNION SELECT projection, release, 'grace' FROM r WHERE made > TIMESTAMP '2024-02-08'
  UNION SELECT projection, release, k.reason FROM r JOIN k USING (token) WHERE k.reason IS NOT NULL)"""


def _sets(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    token = F.date_format("day", "yyyyMMdd'T'000000'Z'")
    return days.select("day", F.when(F.dayofmonth("day") == 13, "set-first").otherwise(F.concat(F.lit("set-"), token)).alias("set_id"), token.alias("token"))


def _pins(spark):
    return spark.createDataFrame([("feed", "feed-20240130T000000Z", "pointer"), ("search", "search-20240129T000000Z", "pointer"), ("feed", "feed-20240105T000000Z", "digest")], "projection string, release string, reason string")


def _kept(spark, sf_dir):
    return K.retained_sets(_sets(spark, sf_dir), _pins(spark), F.lit(NOW).cast("timestamp"))


@query("ops_06_retained_sets", f"WITH {STORE} SELECT set_id, reason FROM k WHERE reason IS NOT NULL")
def retained_sets(spark, sf_dir):
    return _kept(spark, sf_dir)


def _listed(spark, sf_dir):
    return _sets(spark, sf_dir).select("set_id", F.explode(F.array(F.lit("feed"), F.lit("search"))).alias("projection"), "token").select("projection", F.concat_ws("-", "projection", "token").alias("release"), "set_id")


@query("ops_06_releases", f"WITH {RELEASES} SELECT projection, release, coalesce(string_agg(DISTINCT x.reason, ',' ORDER BY x.reason), '') AS reasons FROM r LEFT JOIN x USING (projection, release) GROUP BY 1, 2")
def releases(spark, sf_dir):
    named = _listed(spark, sf_dir)
    told = K.classified_releases(named.drop("set_id"), _pins(spark), named, _kept(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return told.select("projection", "release", F.array_join("reasons", ",").alias("reasons"))


@query(
    "fil_16_sweepable",
    f"""WITH RECURSIVE {RELEASES},
    m AS (SELECT DISTINCT event_id FROM events JOIN x ON x.release = 'feed-' || strftime(ts, '%Y%m%dT000000Z')),
    z(event_id) AS (SELECT event_id FROM m UNION SELECT event_id // 3 FROM z)
    SELECT event_id::VARCHAR AS id FROM events WHERE ts < TIMESTAMP '2024-02-08' AND event_id NOT IN (SELECT event_id FROM z)""",
)
def unmarked(spark, sf_dir):
    """Releases that stay mark the events of their day, and each event marks another, on and on."""
    events, named = table(spark, sf_dir, "events"), _listed(spark, sf_dir)
    told = K.classified_releases(named.drop("set_id"), _pins(spark), named, _kept(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    roots = told.filter(F.size("reasons") > 0).select(F.col("release").alias("id"))
    own = F.col("event_id").cast("string")
    of_day = events.select(F.concat(F.lit("feed-"), F.date_format("ts", "yyyyMMdd'T'000000'Z'")).alias("from"), own.alias("to"))
    chain = events.select(own.alias("from"), F.expr("cast(event_id DIV 3 AS string)").alias("to"))
    pool = events.select(own.alias("id"), F.col("ts").alias("uploaded"))
    return K.sweepable(pool, K.reachable(roots, of_day.union(chain)), F.lit(NOW).cast("timestamp")).select("id")


# --- a release that is read while the next one is published ------------------------------------------------------------------------


@query("src_22_pinned_read", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, 'r1' AS release FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pinned_read(spark, sf_dir):
    """Details of labelled documents, read after a second release with other texts has replaced the first."""
    root, docs = scratch_path(spark, "pinned"), table(spark, sf_dir, "documents").select("doc_id", "text")
    N.publish_details(docs, "doc_id", root, "r1")
    held = N.pin(spark, root)
    N.publish_details(docs.withColumn("text", F.lit("other")), "doc_id", root, "r2")
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return held.details(spark, wanted, "doc_id").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.lit(held.release).alias("release"))
