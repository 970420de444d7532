"""Queries over threads, people and reviews: each operator on the test tables, its twin written from the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions import wording as W
from heronry.operators import feed as D
from heronry.operators import identity as N
from heronry.operators import reviews as V
from heronry.plans.base import query, table

AS_OF = "2024-01-31 00:00:00"

# --- the feed: users are records, their events are versions; a user with a marked signup belongs to the user before ------------------

THREADS = """f AS (SELECT user_id AS record, min(ts) AS first_at FROM events GROUP BY 1),
l AS (SELECT DISTINCT user_id AS record FROM events WHERE event_type = 'signup' AND event_id % 3 = 0),
s AS (SELECT f.*, (l.record IS NULL OR p.record IS NULL) AS starts FROM f LEFT JOIN l USING (record) LEFT JOIN f p ON p.record = f.record - 1),
c AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (ORDER BY record) AS part FROM s),
r AS (SELECT record, first_value(record) OVER (PARTITION BY part ORDER BY first_at, record) AS root FROM c)"""
VERSIONS = "v AS (SELECT user_id AS record, event_id, ts AS tm, CASE WHEN event_type = 'error' THEN 'ci[bot]' ELSE 'a' || (event_id % 7) END AS author, 't' || event_id AS title, event_type AS status FROM events)"


def _versions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    author = F.when(F.col("event_type") == "error", "ci[bot]").otherwise(F.concat(F.lit("a"), F.col("event_id") % 7))
    return events.select(F.col("user_id").alias("record"), "event_id", F.col("ts").alias("at"), author.alias("author"), F.concat(F.lit("t"), "event_id").alias("title"), F.col("event_type").alias("status"))


def _relations(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    link = lambda rows, kind, origin: rows.select(F.col("user_id").alias("record"), (F.col("user_id") - 1).alias("other"), F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), F.lit(None).cast("boolean").alias("approved"))
    stated = link(events.filter("event_type = 'signup' AND event_id % 3 = 0"), "reply-to", "source")
    proposed = link(events.filter("event_type = 'click'"), "reply-to", "model")
    other = link(events.filter("event_type = 'view'"), "mentions", "source")
    return stated.unionByName(proposed).unionByName(other)


@query(
    "sch_17_feed",
    f"""WITH {THREADS}, {VERSIONS},
    n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY record ORDER BY tm DESC, event_id DESC) = 1),
    g AS (SELECT root, count(*) AS n_records, max(tm) AS newest, max(CASE WHEN n.record = root THEN title END) AS title FROM n JOIN r USING (record) GROUP BY root),
    t AS (SELECT root, status FROM n JOIN r USING (record) QUALIFY row_number() OVER (PARTITION BY root ORDER BY tm DESC, n.record DESC) = 1),
    a AS (SELECT root, count(DISTINCT author) AS n_people, count_if(tm BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31') AS activity FROM v JOIN r USING (record) WHERE author NOT LIKE '%[bot]' GROUP BY root),
    o AS (SELECT g.root, title, status, n_records, coalesce(n_people, 0) AS n_people, coalesce(activity, 0) AS activity, newest, row_number() OVER (ORDER BY coalesce(activity, 0) DESC, newest DESC, g.root)::INT AS rank FROM g JOIN t USING (root) LEFT JOIN a USING (root))
    SELECT root, title, status, n_records, n_people, activity, epoch_us(newest) AS newest_us, rank FROM o WHERE rank <= 50""",
)
def feed(spark, sf_dir):
    return D.feed(_versions(spark, sf_dir), _relations(spark, sf_dir), AS_OF).select("root", "title", "status", "n_records", "n_people", "activity", F.unix_micros("newest").alias("newest_us"), "rank")


@query("gra_02_threads", f"WITH {THREADS} SELECT record, root FROM r")
def threads(spark, sf_dir):
    first = _versions(spark, sf_dir).groupBy("record").agg(F.min("at").alias("at"))
    return D.thread_roots(first, _relations(spark, sf_dir))


@query("fil_10_trusted", "SELECT event_id, event_type = 'signup' AND (event_id % 2 = 0 OR event_id % 5 = 0) AS trusted FROM events")
def trusted(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "part-of").otherwise("mentions")
    origin = F.when(F.col("event_id") % 2 == 0, "source").otherwise("model")
    approved = F.when(F.col("event_id") % 5 == 0, True).when(F.col("event_id") % 3 == 0, False)
    return table(spark, sf_dir, "events").select("event_id", D.trusted(kind, origin, approved).alias("trusted"))


# --- identities --------------------------------------------------------------------------------------------------------------------


@query("gra_05_newest_facts", "SELECT user_id, substr(max(strftime(ts, '%Y-%m') || event_type), 8) AS event_type FROM events GROUP BY user_id")
def newest_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return N.newest_facts(rows, "user_id", "event_type", "month")


@query("gra_06_states", "SELECT user_id, coalesce(arg_max(CASE event_type WHEN 'error' THEN 'failed' ELSE 'paid' END, ts) FILTER (event_type IN ('error', 'purchase')), 'open') AS state FROM events GROUP BY user_id")
def states(spark, sf_dir):
    return N.states_of(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", {"error": "failed", "purchase": "paid"})


@query(
    "gra_07_person_facts",
    """WITH f AS (SELECT user_id % 20 AS person, event_id % 50 AS item, CASE event_type WHEN 'signup' THEN 'author' WHEN 'purchase' THEN 'assignee' ELSE 'starter' END AS role FROM events WHERE event_type IN ('signup', 'purchase', 'click'))
    SELECT person, item, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM f GROUP BY person, item""",
)
def person_facts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of = lambda kind: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("id"), (F.col("event_id") % 50).alias("item"))
    persons = events.select(F.col("user_id").alias("id")).distinct().withColumn("person", F.col("id") % 20)
    return N.person_facts(of("signup"), of("purchase"), of("click"), persons).withColumn("roles", F.array_join("roles", ","))


# --- reviews and people --------------------------------------------------------------------------------------------------------------


@query(
    "agg_18_month_rows",
    """WITH k AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY ALL),
    t AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS events, count(DISTINCT event_id % 40) AS threads, count(DISTINCT ts::DATE) AS days FROM events GROUP BY ALL)
    SELECT t.*, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM k WHERE k.user_id = t.user_id AND k.month = t.month) AS kinds FROM t""",
)
def month_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("thread", F.col("event_id") % 40)
    rows = V.month_rows(events, "user_id", "thread", "event_type", "ts")
    return rows.withColumn("kinds", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query(
    "agg_20_profile_totals",
    """WITH e AS (SELECT user_id % 50 AS person, event_type AS state, user_id AS item, json_extract(props, '$.k')::BIGINT AS comments, event_id % 9 AS reviewer, event_id % 11 = 0 AS hidden FROM events),
    s AS (SELECT person, state, count(*) AS n FROM e GROUP BY ALL)
    SELECT person, count(*) AS reviews, count(DISTINCT item) AS items, sum(comments)::BIGINT AS comments, count(DISTINCT CASE WHEN NOT hidden THEN reviewer END) + count_if(hidden) AS reviewers,
    (SELECT string_agg(state || '=' || n, ',' ORDER BY state) FROM s WHERE s.person = e.person) AS by_state FROM e GROUP BY person""",
)
def profile_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("person"), F.col("event_type").alias("state"), F.col("user_id").alias("item"), F.get_json_object("props", "$.k").cast("long").alias("comments"), (F.col("event_id") % 9).alias("reviewer"), (F.col("event_id") % 11 == 0).alias("hidden"))
    totals = V.profile_totals(rows, "person", F.col("hidden"))
    return totals.withColumn("by_state", F.array_join(F.transform(F.map_entries("by_state"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query("fil_14_suppression", "SELECT event_id, CASE WHEN user_id % 10 <> 3 THEN user_id END AS user_id FROM events")
def suppression(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    digests = events.filter("user_id % 10 = 3").select(F.sha2(F.concat_ws(":", F.lit("p"), F.col("user_id").cast("string")), 256).alias("digest"))
    return V.suppressed(events, "p", "user_id", digests, drop=False)


@query(
    "agg_31_pair_dominance",
    """WITH n AS (SELECT user_id AS a, event_type AS b, count(*) AS n FROM events GROUP BY ALL)
    SELECT a, b, n FROM n x WHERE n >= 2 AND n >= 1.25 * coalesce((SELECT max(n) FROM n y WHERE y.a = x.a AND y.b <> x.b), 0) AND n >= 0.5 * coalesce((SELECT max(n) FROM n y WHERE y.b = x.b AND y.a <> x.a), 0)""",
)
def pair_dominance(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("a"), F.col("event_type").alias("b")).agg(F.count("*").alias("n"))
    return V.dominant_pairs(counts, "a", "b", 2, 1.25, 0.5)


@query("agg_15_extras", "SELECT doc_id, coalesce(CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE CASE WHEN toxic = 0 THEN quality::BIGINT END END, NULL) AS v FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL AND d.n_chars IS NOT NULL OR toxic = 0")
def extras(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("v"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 0, F.col("quality").cast("long")).alias("v"))
    return V.merged_extras(old, new, "doc_id", "v")


STAGED = "p AS (SELECT user_id AS key, event_id AS thread, ts AS tm, CASE event_type WHEN 'purchase' THEN 'vote' WHEN 'error' THEN 'result' WHEN 'view' THEN 'discuss' ELSE 'other' END AS stage FROM events)"


def _staged(spark, sf_dir):
    stage = F.when(F.col("event_type") == "purchase", "vote").when(F.col("event_type") == "error", "result").when(F.col("event_type") == "view", "discuss").otherwise("other")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("thread"), F.col("ts").alias("at"), stage.alias("stage"))


@query("agg_12_proposals", f"WITH {STAGED} SELECT key, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages, string_agg(thread, ',' ORDER BY tm DESC, thread DESC) AS cites, epoch_us(max(tm)) AS newest_us FROM p GROUP BY key")
def proposals(spark, sf_dir):
    rows = V.proposal_rows(_staged(spark, sf_dir), "key", "stage", "at", "thread")
    return rows.select("key", F.array_join("stages", ",").alias("stages"), F.array_join(F.transform("cites", lambda x: x.cast("string")), ",").alias("cites"), F.unix_micros("newest").alias("newest_us"))


@query(
    "agg_34_candidates",
    f"""WITH {STAGED}, d AS (SELECT DISTINCT key FROM p WHERE stage = 'result'),
    o AS (SELECT * FROM p WHERE stage IN ('vote', 'discuss') AND key NOT IN (SELECT key FROM d) QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE stage WHEN 'vote' THEN 0 ELSE 1 END, tm DESC, thread DESC) = 1)
    SELECT key, thread, stage FROM o""",
)
def candidates(spark, sf_dir):
    return V.stage_candidates(_staged(spark, sf_dir), "key")


@query("agg_30_first_facts", "SELECT event_type AS key, string_agg(DISTINCT user_id % 7, ',' ORDER BY user_id % 7) AS writers, arg_max(user_id % 7, ts) AS newest, epoch_us(min(ts)) AS first_us FROM events GROUP BY event_type")
def first_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 7).alias("person"), "ts")
    found = V.first_facts(rows, "key", "person", "ts")
    return found.select("key", F.array_join(F.transform("writers", lambda x: x.cast("string")), ",").alias("writers"), "newest", F.unix_micros("first").alias("first_us"))


@query("fil_07_learned_bots", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 3 = 0)")
def learned_bots(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    learned = events.filter("event_type = 'error' AND event_id % 3 = 0").select("user_id").distinct().withColumn("learned", F.lit(True))
    rows = events.join(learned, "user_id", "left")
    return rows.filter(~W.is_learned_bot(F.concat(F.lit("user-"), "user_id"), F.col("learned"))).select("event_id")


@query("fil_09_published", "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'signup' AND p.user_id = e.event_id) OR EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'purchase' AND json_extract(m.props, '$.k')::BIGINT = json_extract(e.props, '$.k')::BIGINT)")
def published(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    cited = events.filter("event_type = 'signup'").select(F.col("user_id").alias("event_id")).distinct()
    named = events.filter("event_type = 'purchase'").select("k").distinct()
    return events.join(cited, "event_id", "left_semi").select("event_id").unionByName(events.join(named, "k", "left_semi").select("event_id")).distinct()
