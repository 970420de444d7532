"""Queries of the core operators over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronry.functions import text as T
from heronry.operators import events as E
from heronry.operators import index as I
from heronry.operators import search as S
from heronry.operators.graph import connected_components
from heronry.plans.base import both, query, table
from heronry.plans.indexes import stored_index

TERMS = ["the", "of", "license"]
AS_OF = "2024-02-01 00:00:00"


# --- search ----------------------------------------------------------------------------------------------------------------

TOKENS_CTE = """
tok AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
stats AS (SELECT count(*) AS n, avg(length) AS mean_length FROM len),
tf AS (SELECT doc_id, any_value(source) AS source, term, count(*) AS tf FROM tok WHERE term IN ('the', 'of', 'license') GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT tf.doc_id, any_value(tf.source) AS source, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 9) AS score
  FROM tf JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN stats GROUP BY tf.doc_id)
"""


def _scored(spark, sf_dir):
    """Scores from the stored index, with the columns of documents that groups and facets need."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return I.scored(spark, stored_index(spark, sf_dir), TERMS).withColumnRenamed("key", "doc_id").join(docs, "doc_id")


BEST = f"WITH {TOKENS_CTE} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20"


@query("sch_03_bm25_top20", BEST)
def bm25_top(spark, sf_dir):
    return I.search_index(spark, stored_index(spark, sf_dir), TERMS, 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("sch_06_whole_release", BEST)
def whole_release(spark, sf_dir):
    """The same over a release without an index: every text is read."""
    docs = table(spark, sf_dir, "documents")
    return S.top(S.bm25_texts(docs, "doc_id", T.simple_tokens("text"), TERMS), "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


@query("agg_05_facets", f"WITH {TOKENS_CTE} SELECT source, count(DISTINCT doc_id) AS groups FROM scored GROUP BY source")
def facets(spark, sf_dir):
    return S.facets(_scored(spark, sf_dir), "source", "doc_id")


@query("agg_04_group_score", f"WITH {TOKENS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rn FROM scored) SELECT source, round(sum(score * pow(0.25, rn - 1)), 4) AS score, count(*) AS matches, min(CASE WHEN rn = 1 THEN doc_id END) AS best FROM r GROUP BY source")
def group_score(spark, sf_dir):
    return S.group_scores(_scored(spark, sf_dir), "source", "doc_id").select("source", F.round("score", 4).alias("score"), "matches", "best")


@query("agg_04_group_score_linear", f"WITH {TOKENS_CTE} SELECT source, round(max(score) + 0.25 * (sum(score) - max(score)), 4) AS score FROM scored GROUP BY source")
def group_score_linear(spark, sf_dir):
    return S.group_scores(_scored(spark, sf_dir), "source", "doc_id", geometric=False).select("source", F.round("score", 4).alias("score"))


@query("agg_01_document_frequency", "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def document_frequency(spark, sf_dir):
    return S.postings(table(spark, sf_dir, "documents"), "doc_id", T.simple_tokens("text")).groupBy("term").agg(F.count("*").alias("df"))


@query("agg_02_mean_length", "SELECT count(*) AS n, round(avg(c), 6) AS mean_length FROM (SELECT len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS c FROM documents) WHERE c > 0")
def mean_length(spark, sf_dir):
    index = S.postings(table(spark, sf_dir, "documents"), "doc_id", T.simple_tokens("text"))
    return S.corpus_statistics(index, "doc_id").select("n", F.round("mean_length", 6).alias("mean_length"))


@query(
    "win_12_chunks",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents WHERE trim(coalesce(text, '')) <> ''),
    c AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 180) / 150.0))::INT + 1)) AS ordinal FROM w)
    SELECT doc_id, ordinal::INT AS ordinal, len(w[ordinal * 150 + 1 : ordinal * 150 + 180])::INT AS n_words, array_to_string(w[ordinal * 150 + 1 : ordinal * 150 + 180], ' ') AS chunk FROM c""",
)
def chunked(spark, sf_dir):
    return S.chunks(table(spark, sf_dir, "documents"), "doc_id")


@query(
    "mat_05_cosine_top",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
    s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], e) AS score FROM embeddings, q)
    SELECT vec_id, label, round(score, 5) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, vec_id LIMIT 30""",
)
def cosine_top(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = S.first_vector(vectors)
    return S.nearest(vectors, first, 30).select("vec_id", "label", F.round("score", 5).alias("score"))


@query(
    "srt_11_nearest_per_label",
    """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
    s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], e) AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM s WHERE score > 0)
    SELECT label, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 3""",
)
def nearest_per_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = S.first_vector(vectors)
    return S.nearest(vectors, first, 3, "label").select("label", "vec_id", F.round("score", 5).alias("score"), "rank")


def _rankings(spark, sf_dir):
    ranked = lambda df, key: df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    lexical = ranked(S.top(_scored(spark, sf_dir), "doc_id", 50), "doc_id")
    vectors = table(spark, sf_dir, "embeddings")
    first = S.first_vector(vectors)
    semantic = ranked(S.nearest(vectors, first, 50), "vec_id").withColumnRenamed("vec_id", "doc_id")
    return lexical, semantic


@query(
    "sch_11_rrf",
    f"""WITH {TOKENS_CTE}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT 50),
    q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
    c AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], e) AS score FROM embeddings, q),
    s AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50)
    SELECT coalesce(l.doc_id, s.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 7) AS score FROM l FULL JOIN s ON l.doc_id = s.doc_id""",
)
def rrf(spark, sf_dir):
    return S.fuse(*_rankings(spark, sf_dir), "doc_id").select("doc_id", F.round("score", 7).alias("score"))


@query(
    "mat_04_ndcg_mrr",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    j AS (SELECT d.source, d.doc_id, l.quality AS grade FROM labels l JOIN documents d USING (doc_id)),
    g AS (SELECT r.*, coalesce(j.grade, 0) AS grade FROM r LEFT JOIN j USING (source, doc_id) WHERE rank <= 20),
    a AS (SELECT source, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS found, coalesce(max(CASE WHEN grade > 0 THEN 1.0::DOUBLE / rank END), 0) AS mrr, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM g GROUP BY source),
    b AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY grade DESC, doc_id) AS rank, grade FROM j WHERE grade > 0),
    i AS (SELECT source, count(*) AS relevant, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS ideal FROM b GROUP BY source)
    SELECT source, round(found / relevant::DOUBLE, 5) AS recall, round(mrr, 5) AS mrr, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 5) AS ndcg FROM a LEFT JOIN i USING (source)""",
)
def ranking_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("rank <= 20").select("source", "doc_id", "rank")
    grades = labels.join(docs.select("doc_id", "source"), "doc_id").select("source", "doc_id", F.col("quality").alias("grade"))
    return S.evaluation(ranked, grades, "source", "doc_id").select("source", *[F.round(c, 5).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(
    "arr_01_weighted_terms",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]+') AS t, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS b FROM documents)
    SELECT doc_id, term, sum(w)::BIGINT AS weight FROM (SELECT doc_id, unnest(t) AS term, 4 AS w FROM d UNION ALL SELECT doc_id, unnest(b), 1 FROM d) GROUP BY 1, 2""",
)
def weighted_terms(spark, sf_dir):
    """Words of a document's first line count four times, those of its text once: weighted term counts."""
    fields = lambda c, w: F.struct(T.simple_tokens(c).alias("t"), F.lit(w).alias("w"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(fields(F.substring_index(T.text("text"), "\n", 1), 4), fields(F.col("text"), 1))).alias("p"))
    return docs.select("doc_id", "p.w", F.explode("p.t").alias("term")).groupBy("doc_id", "term").agg(F.sum("w").alias("weight"))


@query(
    "agg_11_keywords",
    """WITH t AS (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents),
    n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    f AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY lang, term),
    s AS (SELECT lang, term, tf * ln(n / df::DOUBLE) AS score FROM f JOIN d USING (term) CROSS JOIN n),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, term) AS rn FROM s)
    SELECT lang, term, round(score, 6) AS score FROM r WHERE rn <= 5""",
)
def keywords(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("doc_id", "lang", F.explode(F.array_distinct(T.simple_tokens("text"))).alias("term"))
    df, n = terms.groupBy("term").agg(F.count("*").alias("df")), docs.agg(F.count("*").alias("n"))
    scored = terms.groupBy("lang", "term").agg(F.count("*").alias("tf")).join(df, "term").crossJoin(F.broadcast(n))
    scored = scored.withColumn("score", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), "term")
    return scored.withColumn("rn", F.row_number().over(order)).filter("rn <= 5").select("lang", "term", "score")


# --- events ----------------------------------------------------------------------------------------------------------------


@query("win_01_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest(spark, sf_dir):
    return E.current(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("set_01_dedup", "SELECT md5(text) AS content, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text)")
def dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("set_01_dedupe_events", "SELECT event_id, user_id, 0::BIGINT AS conflicts FROM events")
def dedupe_events(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return E.dedupe(events.unionByName(events), ["event_id"], ["user_id", "event_type", "value"], "ts").select("event_id", "user_id", "conflicts")


@query("set_02_append_conflicts", "SELECT count(*) AS stored, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS conflicts FROM events")
def append_conflicts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stored = events.filter("event_id % 2 = 0")
    rows, conflicts = E.append_keeping_stored(stored, events.withColumn("value", F.col("value") + 1), ["event_id"], ["user_id", "value"])
    return rows.agg(F.count("*").alias("stored")).crossJoin(F.broadcast(conflicts.agg(F.count("*").alias("conflicts"))))


@query("stm_05_compact", f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY")
def compacted(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("timestamp")
    return E.compact(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "ts", as_of, 3).select("user_id", "event_id")


@query(
    "agg_08_halflife",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, round(sum(pow(0.5, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400e6 / 3.5) / k), 6) AS score FROM k GROUP BY user_id""",
)
def halflife(spark, sf_dir):
    scored = E.half_life_score(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", F.lit(AS_OF).cast("timestamp"))
    return scored.select("user_id", F.round("score", 6).alias("score"))


@query(
    "agg_26_calendar",
    """WITH c AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
    n AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)
    SELECT c.day, CASE WHEN c.day >= DATE '2024-01-01' THEN coalesce(n.n, 0) END AS n FROM c LEFT JOIN n USING (day)""",
)
def calendar(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-30").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day"))
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    return E.dense_counts(rows, days, "day", F.lit("2024-01-01").cast("date"))


@query(
    "win_10_streak",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM d),
    c AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, max(n) AS streak FROM c GROUP BY user_id""",
)
def streak(spark, sf_dir):
    return E.longest_streak(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query(
    "win_09_failing_run",
    """WITH m AS (SELECT user_id, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS oks FROM events)
    SELECT user_id, sum(CASE WHEN oks = 0 THEN 1 ELSE 0 END)::BIGINT AS failures FROM m GROUP BY user_id""",
)
def failing_run(spark, sf_dir):
    runs = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("ok", F.col("event_type") != "view")
    return E.failing_run(runs, "user_id", "at", "ok")


@query("win_13_running_plan", "SELECT event_type, count(*) FILTER (WHERE total <= 1000) AS called, count(*) FILTER (WHERE total > 1000) AS skipped FROM (SELECT event_type, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM events) GROUP BY event_type")
def running_plan(spark, sf_dir):
    plan = E.spend_plan(table(spark, sf_dir, "events"), "event_type", "event_id", "value", 1000)
    return plan.groupBy("event_type").agg(F.count_if("called").alias("called"), F.count_if(~F.col("called")).alias("skipped"))


@query("win_16_capped", "SELECT source, doc_id, position::INT AS position, greatest(0, n - 3) AS more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE position <= 3")
def capped(spark, sf_dir):
    return E.capped(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id", "position", "more")


@query(
    "win_14_shelf_pack",
    """WITH RECURSIVE i AS (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY source) AS rn FROM documents GROUP BY lang, source),
    f AS (SELECT lang, source, n, rn, 0 AS shard, n AS held FROM i WHERE rn = 1
    UNION ALL SELECT i.lang, i.source, i.n, i.rn, CASE WHEN f.held + i.n > 20 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.held + i.n > 20 THEN i.n ELSE f.held + i.n END FROM f JOIN i ON i.lang = f.lang AND i.rn = f.rn + 1)
    SELECT lang, source, n, shard FROM f""",
)
def shelf_pack(spark, sf_dir):
    items = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return E.shelf_pack(items, "lang", "source", "n", 20)


@query(
    "joi_12_dominance",
    """WITH p AS (SELECT o_custkey, l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    c AS (SELECT a.*, greatest(coalesce((SELECT max(b.n) FROM p b WHERE b.o_custkey = a.o_custkey AND b.l_suppkey <> a.l_suppkey), 0), coalesce((SELECT max(b.n) FROM p b WHERE b.l_suppkey = a.l_suppkey AND b.o_custkey <> a.o_custkey), 0)) AS competitor FROM p a)
    SELECT o_custkey, l_suppkey, n, competitor FROM c WHERE n >= 2 AND n >= 1.0 * competitor""",
)
def dominance(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return E.dominant_pairs(pairs, "o_custkey", "l_suppkey", "l_partkey", 2, 1.0)


@query("joi_07_outer_diff", "SELECT side, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'both' WHEN d.doc_id IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) GROUP BY side")
def outer_diff(spark, sf_dir):
    return E.difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").groupBy("side").agg(F.count("*").alias("n"))


@query("joi_11_range", "WITH b AS (SELECT lo, lead(lo) OVER (ORDER BY lo) AS hi FROM (VALUES (0.0), (50000.0), (150000.0), (300000.0)) v(lo)) SELECT lo::DOUBLE AS lo, count(*) AS n FROM orders JOIN b ON o_totalprice >= lo AND (hi IS NULL OR o_totalprice < hi) GROUP BY lo")
def range_join(spark, sf_dir):
    bounds = spark.createDataFrame([(0.0,), (50000.0,), (150000.0,), (300000.0,)], "lo double")
    return E.boundary_join(table(spark, sf_dir, "orders"), bounds, "o_totalprice", "lo").groupBy("lo").agg(F.count("*").alias("n"))


@query(
    "agg_46_retained",
    """WITH m AS (SELECT DISTINCT o_orderkey, 'pinned' AS reason FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT DISTINCT l_orderkey, 'read' FROM lineitem WHERE l_quantity >= 50),
    r AS (SELECT o_orderkey, list_sort(list(reason)) AS reasons FROM m GROUP BY 1)
    SELECT o_orderkey, array_to_string(reasons, ',') AS reasons, reasons IS NULL AND o_orderdate < TIMESTAMP '1996-01-01' AS candidate FROM orders LEFT JOIN r USING (o_orderkey)""",
)
def retained(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    reasons = {"pinned": orders.filter("o_orderpriority = '1-URGENT'"), "read": items.filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))}
    kept = E.retained(orders, reasons, "o_orderkey", "o_orderdate", F.lit("1996-01-01").cast("timestamp"))
    return kept.select("o_orderkey", F.when(F.col("reasons").isNotNull(), F.array_join("reasons", ",")).alias("reasons"), "candidate")


@query("gra_01_components", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS root FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    order = Window.partitionBy("m").orderBy("doc_id")
    edges = docs.withColumn("a", F.lag("doc_id").over(order)).dropna().select("a", F.col("doc_id").alias("b"))
    return connected_components(edges)


both("stm_session", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM {events} GROUP BY user_id, session_window(ts, '6 hours')", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s", "events")
both("agg_21_conditional_counts", "SELECT user_id, count_if(event_type = 'click') AS clicks, count(DISTINCT CASE WHEN event_type = 'view' THEN to_date(ts) END) AS view_days, count(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT CASE WHEN event_type = 'view' THEN ts::DATE END) AS view_days, count(DISTINCT event_type) AS kinds FROM {events} GROUP BY user_id", "events")
both("agg_39_median", "SELECT event_type, round(percentile(value, 0.5), 6) AS median FROM {events} GROUP BY event_type", "SELECT event_type, round(median(value), 6) AS median FROM {events} GROUP BY event_type", "events")
both("jsn_06_props", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events}", "events")
both("dat_03_months", "SELECT date_format(ts, 'yyyy-MM') AS month, event_type, count(*) AS n FROM {events} GROUP BY 1, 2", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM {events} GROUP BY 1, 2", "events")
both("dat_05_weeks", "SELECT CAST(date_trunc('WEEK', ts) AS DATE) AS week, count(*) AS n FROM {events} GROUP BY 1", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM {events} GROUP BY 1", "events")
both("agg_38_grouping_sets", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM {documents} GROUP BY GROUPING SETS ((lang), (lang, source), ())", tables="documents")
both("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", tables="orders")
both("agg_33_thread_stats", "SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS roles, min_by(role, turn) AS root_role, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id", "SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS roles, arg_min(role, turn) AS root_role, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id", "conversations")
both("set_except", "SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}", tables="documents labels")
both("set_intersect", "SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}", tables="documents labels")
both("joi_05_self_pairs", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey", tables="supplier")
both("joi_06_semi_or", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN (SELECT o_custkey AS k FROM {orders} UNION SELECT s_suppkey FROM {supplier}) u ON c_custkey = u.k", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} UNION SELECT s_suppkey FROM {supplier})", "customer orders supplier")
both("joi_01_profile_join", "SELECT n_name, r_name, count(*) AS customers FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name, r_name", tables="customer nation region")
both("joi_14_unique_names", "WITH u AS (SELECT n_regionkey, min(n_name) AS n_name FROM {nation} GROUP BY n_regionkey, substring(n_name, 8, 1) HAVING count(*) = 1) SELECT n_name, r_name FROM u JOIN {region} ON n_regionkey = r_regionkey", tables="nation region")
both("fil_11_browse", "SELECT doc_id FROM {documents} WHERE lang = 'en' AND instr(lower(text), 'license') > 0", tables="documents")
both("fil_05_half_open", "SELECT event_id FROM {events} WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'", tables="events")
both("jsn_02_ids", "SELECT doc_id, substring(sha2(concat(source, '/', CAST(doc_id AS STRING)), 256), 1, 8) AS id FROM {documents}", "SELECT doc_id, substring(sha256(concat(source, '/', CAST(doc_id AS VARCHAR))), 1, 8) AS id FROM {documents}", "documents")
both("agg_41_status_counts", "SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus", tables="orders")
both("agg_14_latest_state", "SELECT user_id, event_type, n, rank FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM {events}) WHERE rank <= 2", tables="events")
both("srt_09_natural_order", "SELECT source, CAST(row_number() OVER (ORDER BY regexp_extract(source, '^[a-z]+', 0), CAST(regexp_extract(source, '[0-9]+', 0) AS INT)) AS BIGINT) AS place FROM (SELECT DISTINCT source FROM {documents})", tables="documents")
both("srt_01_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", tables="orders")
both("str_20_html_title", r"SELECT page_id, trim(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1)) AS title FROM {pages}", tables="pages")
both("str_12_thread_key", r"SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(text, '(?i)^(\\s*(re|fwd?|fw|aw)\\s*:\\s*)+', ''), '[ \\t\\n\\r]+', ' '))) AS thread FROM {conversations}", r"SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(text, '(?i)^(\s*(re|fwd?|fw|aw)\s*:\s*)+', ''), '[ \t\n\r]+', ' ', 'g'))) AS thread FROM {conversations}", "conversations")
both("agg_40_overage", "SELECT l_returnflag, floor(round(sum(greatest(l_quantity - 25, 0)) * 100) / 100) AS overage FROM {lineitem} GROUP BY l_returnflag", tables="lineitem")
