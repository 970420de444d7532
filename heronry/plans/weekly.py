"""The weekly digest over events: users are threads, their events records; what a model would write is made from the events' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import digest as D
from heronry.plans.base import query, table
from heronry.scratch import scratch_path

END = "2024-01-31 00:00:00"
RULES = D.Rules(("ci[bot]",), (("t1", "(?i)click"), ("t2", "(?i)purchase"), ("t3", "(?i)nothing")), "(?i)^routine")

#: Threads, what the model said about them, its sentences, and which proposals they belong to.
INPUTS = """f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS head, arg_max(event_type, (ts, event_id)) AS tail FROM events GROUP BY user_id),
th AS (SELECT 't' || user_id AS thread, CASE WHEN user_id % 11 = 0 THEN 'routine ' ELSE '' END || head || CASE WHEN user_id % 4 = 0 THEN ' [announce]' ELSE '' END AS title, CASE WHEN tail = 'purchase' THEN 'merged' ELSE tail END AS status FROM f),
cl AS (SELECT 't' || user_id AS thread, 't' || (user_id % 5) AS topic, (user_id % 10) / 10.0 AS confidence, user_id % 6 = 0 AS routine, (user_id % 9) / 9.0 AS rc FROM f WHERE user_id % 7 <> 0),
se AS (SELECT CASE WHEN event_id % 31 = 0 THEN 'highlight' ELSE 't' || (1 + event_id % 3) END AS place, event_id AS position,
   CASE event_id % 5 WHEN 0 THEN 'it was merged ' WHEN 1 THEN 'they pushed  back on ' WHEN 2 THEN 'it was released with ' WHEN 3 THEN repeat('long ', 60) ELSE 'plain news of ' END || event_id AS sentence,
   CASE WHEN event_id % 13 = 0 THEN [] ELSE ['t' || user_id] END AS cites FROM events WHERE value > 40)"""
STAGES = """r AS (SELECT 't' || user_id AS thread, event_id, ts, 'a' || (event_id % 7) AS author FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31'),
k AS (SELECT *, row_number() OVER (PARTITION BY thread, author ORDER BY ts, event_id) AS k FROM r),
c AS (SELECT thread, round(sum(0.5 ** ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0 / 3.5) / k), 9) AS score, max(ts) AS newest FROM k GROUP BY thread),
m AS (SELECT th.*, c.score, c.newest, cl.thread IS NOT NULL AS known, cl.topic AS said, cl.confidence, cl.routine, cl.rc,
  CASE WHEN regexp_matches(title, '(?i)click') THEN 't1' WHEN regexp_matches(title, '(?i)purchase') THEN 't2' ELSE 'other' END AS ruled FROM c JOIN th USING (thread) LEFT JOIN cl USING (thread)),
p AS (SELECT *, CASE WHEN known AND confidence >= 0.35 AND said IN ('t1', 't2', 't3') THEN said ELSE ruled END AS topic, CASE WHEN known THEN routine AND rc >= 0.6 ELSE title LIKE 'routine%' END AS dull FROM m),
x AS (SELECT *, CASE WHEN dull THEN 'routine' WHEN topic = 'other' THEN 'uncategorized' ELSE 'card' END AS place FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY place, CASE WHEN place = 'card' THEN topic END ORDER BY score DESC, thread) AS nth FROM x),
cd AS (SELECT topic, count(*) AS size, row_number() OVER (ORDER BY round(sum(CASE WHEN nth <= 3 THEN score END), 9) DESC, topic) AS rank FROM n WHERE place = 'card' GROUP BY topic),
ck AS (SELECT se.*, len(cites) = 0 AS bare, x.thread AS found, x.topic, x.place AS at_place, x.status, x.title FROM se LEFT JOIN x ON x.thread = cites[1]),
rs AS (SELECT *, CASE WHEN length(sentence) > 240 THEN 'length' WHEN bare THEN 'no-cites' WHEN place <> 'highlight' AND NOT coalesce(at_place = 'card' AND topic = place, false) THEN 'cite-outside-inputs' END AS early,
  CASE WHEN sentence LIKE '%merged%' AND NOT coalesce(status IN ('merged', 'resolved'), false) THEN 'status:merged' WHEN sentence LIKE '%released%' AND NOT coalesce(title LIKE '%[announce]%', false) THEN 'status:released' WHEN sentence LIKE '%pushed%' THEN 'stance:pushed back' END AS late FROM ck),
ts AS (SELECT *, coalesce(early, late) AS reason FROM rs WHERE place <> 'highlight'),
st AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY position) AS nth FROM ts WHERE reason IS NULL QUALIFY nth <= 3),
hl AS (SELECT *, coalesce(early, CASE WHEN cites[1] NOT IN (SELECT cites[1] FROM st) THEN 'cite-outside-inputs' END, late) AS reason FROM rs WHERE place = 'highlight'),
pr AS (SELECT 'p' || (user_id % 3) AS proposal, user_id % 3 AS rank, 't' || user_id AS thread FROM f WHERE user_id % 8 = 0),
fp AS (SELECT 0 AS turn, thread, title FROM pr JOIN x USING (thread) ORDER BY pr.rank, newest DESC, thread LIMIT 1),
tp AS (SELECT cd.rank AS turn, thread, title FROM n JOIN cd USING (topic) WHERE place = 'card' AND thread NOT IN (SELECT thread FROM fp) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, thread) = 1),
fb AS (SELECT row_number() OVER (ORDER BY turn) AS rank, title FROM (SELECT * FROM fp UNION ALL SELECT * FROM tp) ORDER BY turn LIMIT 3),
vh AS (SELECT row_number() OVER (ORDER BY position) AS rank, sentence FROM hl WHERE reason IS NULL ORDER BY position LIMIT 3)"""


def _inputs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of_user = events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("head"), F.max_by("event_type", F.struct("ts", "event_id")).alias("tail"))
    u = F.col("user_id")
    thread = F.concat(F.lit("t"), u)
    title = F.concat(F.when(u % 11 == 0, "routine ").otherwise(""), "head", F.when(u % 4 == 0, " [announce]").otherwise(""))
    threads = of_user.select(thread.alias("thread"), title.alias("title"), F.when(F.col("tail") == "purchase", "merged").otherwise(F.col("tail")).alias("status"), F.lit("mail").alias("kind"))
    classified = of_user.filter("user_id % 7 <> 0").select(thread.alias("thread"), F.concat(F.lit("t"), u % 5).alias("topic"), (u % 10 / 10).alias("confidence"), (u % 6 == 0).alias("routine"), (u % 9 / 9).alias("routine_confidence"))
    author = F.when(F.col("event_type") == "error", "ci[bot]").otherwise(F.concat(F.lit("a"), F.col("event_id") % 7))
    records = events.select(thread.alias("thread"), F.col("event_id").alias("record"), author.alias("author"), F.col("ts").alias("at"))
    e = F.col("event_id")
    words = F.when(e % 5 == 0, "it was merged ").when(e % 5 == 1, "they pushed  back on ").when(e % 5 == 2, "it was released with ").when(e % 5 == 3, "long " * 60).otherwise("plain news of ")
    place = F.when(e % 31 == 0, "highlight").otherwise(F.concat(F.lit("t"), 1 + e % 3))
    cites = F.when(e % 13 == 0, F.expr("cast(array() AS array<string>)")).otherwise(F.array(thread))
    sentences = events.filter("value > 40").select(place.alias("place"), e.alias("position"), F.concat(words, e).alias("sentence"), cites.alias("cites"))
    proposals = of_user.filter("user_id % 8 = 0").select((u % 3).alias("rank"), thread.alias("thread"))
    return records, threads, classified, sentences, proposals


@query(
    "sch_18_digest",
    f"""WITH {INPUTS}, {STAGES}
    SELECT 'cards' AS section, rank::INT AS rank, topic AS key, size::VARCHAR AS value FROM cd
    UNION ALL SELECT 'threads', nth::INT, topic, thread FROM n WHERE place = 'card'
    UNION ALL SELECT place, nth::INT, '', thread FROM n WHERE place <> 'card'
    UNION ALL SELECT 'sentences', nth::INT, place, sentence FROM st
    UNION ALL SELECT 'rejected', 0, reason, count(*)::VARCHAR FROM (SELECT reason FROM ts UNION ALL SELECT reason FROM hl) WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'highlights', rank::INT, 'valid', sentence FROM vh
    UNION ALL SELECT 'highlights', rank::INT, 'fallback', title FROM fb WHERE NOT EXISTS (SELECT 1 FROM vh)""",
)
def weekly_digest(spark, sf_dir):
    return D.digest(spark, scratch_path(spark, "digest"), *_inputs(spark, sf_dir), F.lit(END).cast("timestamp"), RULES)


@query("srt_14_fallback_picks", f"WITH {INPUTS}, {STAGES} SELECT rank::INT AS rank, title, true AS fallback FROM fb")
def fallback_picks(spark, sf_dir):
    """Highlights of a week in which the model wrote none that stands."""
    records, threads, classified, sentences, proposals = _inputs(spark, sf_dir)
    mixed = D.placed(D.candidates(records, threads, F.lit(END).cast("timestamp"), RULES), classified, RULES)
    nothing = sentences.filter("false").select("position", "sentence", "cites")
    return D.highlights(nothing, mixed, D.cards(mixed), proposals).select("rank", "title", "fallback")


@query("fil_13_candidates", f"WITH {INPUTS}, {STAGES} SELECT thread, round(score, 6) AS score, epoch_us(newest) AS newest_us FROM c")
def digest_candidates(spark, sf_dir):
    records, threads, *_ = _inputs(spark, sf_dir)
    return D.candidates(records, threads, F.lit(END).cast("timestamp"), RULES).select("thread", F.round("score", 6).alias("score"), F.unix_micros("newest").alias("newest_us"))


@query(
    "agg_42_digest_evaluation",
    f"""WITH {INPUTS}, {STAGES} SELECT 'rejected' AS measure, reason AS key, count(*)::DOUBLE AS value FROM ts WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'recall', 'cards', avg(CASE WHEN x.place = 'card' THEN 1.0 ELSE 0.0 END) FROM th LEFT JOIN x USING (thread) WHERE th.status = 'merged'""",
)
def digest_evaluation(spark, sf_dir):
    records, threads, classified, sentences, _ = _inputs(spark, sf_dir)
    mixed = D.placed(D.candidates(records, threads, F.lit(END).cast("timestamp"), RULES), classified, RULES)
    given = mixed.filter("place = 'card'").select(F.col("topic").alias("place"), "thread")
    told = D.checked(sentences.filter("place <> 'highlight'"), mixed, given)
    return D.rejected_and_recall(told, mixed, threads.filter("status = 'merged'"))
