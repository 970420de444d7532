"""Gates, months, trends and plans over the test tables; a share of the rows is made wrong in a known way, so each issue has rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import contracts as K
from heronry.plans.base import query, table

col, lit = F.col, F.lit


def _events(spark, sf_dir):
    e = col("event_id")
    made = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(e % 7 == 0, "state-changed").when(e % 7 == 1, "guessed").otherwise("updated")
    data = F.when(e % 11 == 0, None).otherwise(F.create_map(lit("artifactType"), lit("issue"), lit("after"), F.when(e % 14 == 0, " ").otherwise("closed")))
    return table(spark, sf_dir, "events").select(
        e.cast("string").alias("id"), F.when(e % 13 == 0, "").otherwise("p").alias("projectId"), F.when(e % 5 == 0, "fax").otherwise("wiki").alias("sourceType"), F.when(e % 21 == 0, "thread").otherwise("artifact").alias("entityType"),
        col("user_id").cast("string").alias("entityId"), kind.alias("eventType"), F.when(e % 9 == 0, "ftp://x").otherwise("https://x/y").alias("canonicalUrl"), made.alias("sourceTimestamp"), F.when(e % 17 == 0, "2024-13-01T00:00:00Z").otherwise(made).alias("observedAt"), data.alias("data"),
    )


@query(
    "fil_17_event_gate",
    """SELECT event_id::VARCHAR AS id, array_to_string(list_sort(list_filter([
      CASE WHEN event_id % 13 = 0 THEN 'projectId must be a non-empty string' END, CASE WHEN event_id % 5 = 0 THEN 'sourceType is not supported' END, CASE WHEN event_id % 7 = 1 THEN 'eventType is not supported' END,
      CASE WHEN event_id % 9 = 0 THEN 'canonicalUrl must be an HTTP(S) URL' END, CASE WHEN event_id % 17 = 0 THEN 'observedAt must be UTC ISO-8601' END, CASE WHEN event_id % 11 = 0 THEN 'data must be an object' END,
      CASE WHEN event_id % 21 = 0 THEN 'state-changed event must target an artifact' END, CASE WHEN event_id % 14 = 0 AND event_id % 11 <> 0 THEN 'data.after must be a non-empty string' END], lambda x: x IS NOT NULL)), '; ') AS issues FROM events""",
)
def event_gate(spark, sf_dir):
    return K.gated(_events(spark, sf_dir)).select("id", F.array_join("issues", "; ").alias("issues"))


CONTRACTS = {"github-record@1": {"number": "number", "author": "string", "isBot": "boolean"}, "mail-record@1": {"mid": "string"}}


@query(
    "fil_18_payload_gate",
    """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'unknown contract' WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'mid must be a string' ELSE '' END WHEN event_id % 5 = 0 THEN 'payload must be an object'
      ELSE array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'author must be a string' END, CASE WHEN event_id % 3 = 0 THEN 'isBot must be a boolean' END], lambda x: x IS NOT NULL), '; ') END AS issues FROM events""",
)
def payload_gate(spark, sf_dir):
    e = col("event_id")
    code = F.concat(lit('{"number":'), e, lit(',"author":'), F.when(e % 2 == 0, lit("7")).otherwise(lit('"ada"')), lit(',"isBot":'), F.when(e % 3 == 0, lit("null")).otherwise(lit("false")), lit("}"))
    mail = F.concat(lit('{"mid":'), F.when(e % 3 == 0, lit("[1]")).otherwise(lit('"m"')), lit("}"))
    kind = col("event_type")
    contract = F.when(kind == "error", "fax@1").when(kind == "view", "mail-record@1").otherwise("github-record@1")
    payload = F.when(kind == "view", mail).when(e % 5 == 0, lit("{broken")).otherwise(code)
    rows = table(spark, sf_dir, "events").select(e.alias("id"), contract.alias("contract"), payload.alias("payload"))
    return rows.select("id", F.array_join(K.payload_issues(col("contract"), col("payload"), CONTRACTS), "; ").alias("issues"))


@query(
    "fil_19_profile_gate",
    """WITH p AS (SELECT n_nationkey AS profile, n_nationkey % 5 AS version, CASE WHEN n_nationkey % 7 <> 0 THEN 's' || s_suppkey % 6 END AS source, (s_suppkey % 4)::VARCHAR AS instance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey)
    SELECT profile, 'version must be positive' AS issue FROM p GROUP BY profile HAVING max(version) <= 0 UNION ALL SELECT profile, 'no source' FROM p GROUP BY profile HAVING count(source) = 0
    UNION ALL SELECT profile, 'repeated source ' || source || ' ' || instance FROM p WHERE source IS NOT NULL GROUP BY profile, source, instance HAVING count(*) > 1""",
)
def profile_gate(spark, sf_dir):
    n, s = col("n_nationkey"), col("s_suppkey")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), n == col("s_nationkey"), "left")
    source = F.when(n % 7 != 0, F.concat(lit("s"), s % 6))
    return K.profile_issues(rows.select(n.alias("profile"), (n % 5).alias("version"), source.alias("source"), (s % 4).cast("string").alias("instance")))


@query("fil_15_kinds", "WITH k AS (SELECT CASE event_type WHEN 'click' THEN 'pr' WHEN 'view' THEN 'mail' WHEN 'signup' THEN 'jira' ELSE 'github' END AS kind FROM events) SELECT kind, count(*) AS n FROM k WHERE kind <> 'github' GROUP BY kind UNION ALL SELECT 'all', count(*) FROM k")
def thread_kinds(spark, sf_dir):
    e = col("event_id")
    kind = F.when(col("event_type") == "click", "pr").when(col("event_type") == "view", "mail").when(col("event_type") == "signup", "jira").otherwise("github")
    return K.kinds(table(spark, sf_dir, "events").select(e.alias("thread"), kind.alias("kind")))


@query("ops_11_run_cost", "SELECT event_type AS stage, round(sum(value), 4) AS cold, round(coalesce(sum(value) FILTER (ts > TIMESTAMP '2024-01-24'), 0), 4) AS steady FROM events GROUP BY event_type")
def run_cost(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(col("event_type").alias("stage"), col("value").alias("units"), col("ts").alias("changed_at"))
    told = K.run_cost(calls, lit("2024-01-24").cast("timestamp"))
    return told.select("stage", F.round("cold", 4).alias("cold"), F.round("steady", 4).alias("steady"))


@query(
    "ops_19_backfilled_month",
    """WITH n AS (SELECT o_orderkey AS number, o_custkey, o_orderkey % 4 = 0 AS bot, CASE WHEN o_orderkey % 5 <> 0 THEN ['K-' || o_custkey, 'K-' || o_custkey % 10] ELSE [] END AS keys FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-05'),
    k AS (SELECT DISTINCT unnest(keys) AS key FROM n)
    SELECT 'PR-' || number AS thread, 'pull-request' AS kind, CASE WHEN NOT bot THEN 'u' || o_custkey END AS author, NULL AS assignee, CASE WHEN o_custkey < 10 THEN 'K-' || o_custkey ELSE 'K-' || o_custkey % 10 || ',K-' || o_custkey END AS keys FROM n WHERE len(keys) > 0
    UNION ALL SELECT 'K-' || c_custkey, 'issue', NULL, CASE WHEN c_custkey % 3 <> 0 THEN c_name END, 'K-' || c_custkey FROM customer WHERE c_custkey % 6 <> 1 AND 'K-' || c_custkey IN (SELECT key FROM k)""",
)
def backfilled_month(spark, sf_dir):
    k, c = col("o_orderkey"), col("o_custkey")
    keys = F.when(k % 5 != 0, F.array(F.concat(lit("K-"), c), F.concat(lit("K-"), c % 10))).otherwise(F.expr("cast(array() AS array<string>)"))
    nodes = table(spark, sf_dir, "orders").select(k.alias("number"), lit("t").alias("title"), F.concat(lit("u"), c).alias("author"), (k % 4 == 0).alias("bot"), col("o_orderdate").alias("created_at"), keys.alias("keys"))
    people = table(spark, sf_dir, "customer").filter("c_custkey % 6 <> 1").select(F.concat(lit("K-"), "c_custkey").alias("key"), F.when(col("c_custkey") % 3 != 0, col("c_name")).alias("assignee"))
    return K.backfilled_month(nodes, people, "1997-05").withColumn("keys", F.array_join("keys", ","))


@query(
    "ops_21_front_matter_plan",
    """SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 3 = 0 OR page_id % 2 = 0 THEN 'changed' ELSE 'unchanged' END AS plan,
      CASE WHEN page_id % 5 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN page_id % 2 = 0 THEN 'url' END, CASE WHEN page_id % 3 = 0 THEN 'version' END], lambda x: x IS NOT NULL), ',') END AS drift FROM pages""",
)
def front_matter_plan(spark, sf_dir):
    p = col("page_id")
    pages = table(spark, sf_dir, "pages").select(p.alias("id"), F.create_map(lit("url"), col("url"), lit("version"), p.cast("string")).alias("fields"))
    entry = lambda k, v: F.struct(lit(k).alias("key"), v.alias("value"))
    old = F.map_from_entries(F.array_compact(F.array(F.when(p % 2 != 0, entry("url", col("url"))), entry("version", F.when(p % 3 == 0, "-1").otherwise(p.cast("string"))), entry("own", lit("x")))))
    notes = table(spark, sf_dir, "pages").filter(p % 5 != 0).select(p.alias("id"), old.alias("fields"))
    return K.front_matter_plan(notes, pages).withColumn("drift", F.array_join("drift", ","))


@query(
    "ops_25_trends",
    """WITH c AS (SELECT c_nationkey AS project, c_custkey % 4 <> 0 AS recorded, min(o_orderdate) OVER (PARTITION BY o_custkey) AS since, o_orderdate AS until, strftime(o_orderdate, '%Y-%m') AS month FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate < TIMESTAMP '1997-01-01' + to_days((c_nationkey * 40)::INT)),
    f AS (SELECT project, min(month) AS first, list(DISTINCT month[1:4]) FILTER (month LIKE '%-01') AS y FROM c GROUP BY project)
    SELECT project, bool_or(recorded) AS visible, epoch_us(TIMESTAMP '1999-06-01') - epoch_us(max(until)) > 48 * 3600000000 AS stale, epoch_us(min(since) FILTER (recorded AND since > CAST(first || '-01' AS TIMESTAMP))) AS marker_us,
      coalesce(array_to_string(list_sort(list_filter(any_value(y), lambda x: x <> CASE WHEN any_value(first) LIKE '%-01' THEN any_value(first)[1:4] ELSE '' END)), ','), '') AS years FROM c JOIN f USING (project) GROUP BY project""",
)
def trends(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), col("o_custkey") == col("c_custkey"))
    rows = orders.filter(col("o_orderdate") < F.expr("timestamp '1997-01-01' + make_dt_interval(c_nationkey * 40)"))
    since = F.min("o_orderdate").over(Window.partitionBy("o_custkey"))
    told = rows.select(col("c_nationkey").alias("project"), (col("c_custkey") % 4 != 0).alias("recorded"), since.alias("since"), col("o_orderdate").alias("until"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    out = K.trend(told.drop("month"), told.select("project", "month"), lit("1999-06-01").cast("timestamp"))
    return out.select("project", "visible", "stale", F.unix_micros("marker").alias("marker_us"), F.array_join("years", ",").alias("years"))
