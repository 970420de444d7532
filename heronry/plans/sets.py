"""Queries over sets of records: chains of parents, uniqueness, unions, parity, orders, neighbours, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronry.operators import records as R
from heronry.plans.base import query, table

col = F.col
NOW = "2024-02-01 00:00:00"


@query("joi_03_parent_roots", "WITH RECURSIVE u AS (SELECT DISTINCT user_id AS id FROM events), r AS (SELECT id, id AS root FROM u WHERE id % 10 = 0 UNION ALL SELECT u.id, r.root FROM r JOIN u ON u.id = r.id + 1 AND u.id % 10 <> 0) SELECT u.id, r.root, CASE WHEN r.root IS NULL THEN 'missing' ELSE 'ok' END AS state FROM u LEFT JOIN r USING (id)")
def parent_roots(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(col("user_id").alias("id")).distinct()
    rows = users.select("id", F.when(col("id") % 10 != 0, col("id") - 1).alias("parent"), F.lit("s").alias("scope"))
    return R.parent_roots(rows, "id", "parent", "scope")


@query("joi_19_rostered", "SELECT user_id, user_id % 6 IN (SELECT c_custkey % 6 FROM customer WHERE c_custkey % 9 = 4) AS binding FROM (SELECT DISTINCT user_id FROM events)")
def rostered(spark, sf_dir):
    votes = table(spark, sf_dir, "events").select("user_id", (col("user_id") % 6).alias("name_key")).distinct()
    roster = table(spark, sf_dir, "customer").select((col("c_custkey") % 6).alias("name_key"), F.array(F.when(col("c_custkey") % 9 == 4, "pmc").otherwise("committer")).alias("roles"))
    return R.rostered(votes, roster, "pmc").select("user_id", "binding")


@query("joi_23_diff", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'changed' ELSE 'kept' END AS change FROM documents")
def diffed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    new = docs.filter("doc_id % 4 <> 1").withColumn("lang", F.when(col("doc_id") % 4 == 2, F.upper("lang")).otherwise(col("lang")))
    return R.diffed(docs.filter("doc_id % 4 <> 0"), new, "doc_id", "lang")


@query("joi_25_queue", "SELECT page_id, upper(url) AS title, CASE WHEN page_id % 5 = 0 THEN 'done' WHEN page_id % 3 = 0 THEN 'held' ELSE 'new' END AS state FROM pages")
def queue(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.upper("url").alias("title"))
    previous = pages.filter("page_id % 3 = 0").select("page_id", F.lit("held").alias("state"))
    return R.merged_queue(pages, previous, pages.filter("page_id % 5 = 0"), "page_id")


@query("agg_49_status_breakdown", "SELECT CASE WHEN page_id % 5 = 0 THEN 'done' WHEN page_id % 3 = 0 THEN 'held' ELSE 'new' END AS state, count(*) AS n FROM pages GROUP BY 1")
def status_breakdown(spark, sf_dir):
    return queue(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query("set_05_unique", "SELECT DISTINCT source, lang, sha256(source || lang) AS content FROM documents")
def unique(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.concat("source", "lang").alias("key"), F.sha2(F.concat("source", "lang"), 256).alias("content"))
    return R.unique_or_fail(rows, "key", col("content")).select("source", "lang", "content")


@query("set_10_union_newer", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS side FROM documents UNION SELECT doc_id, 'new' FROM labels")
def union_newer(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("side"))
    return R.union_newer(old, table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("side", F.lit("new")), "doc_id")


@query("set_13_parity", "SELECT true AS same, false AS other")
def parity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    equal = lambda other: R.parity(docs, other).first()["equal"]
    return spark.createDataFrame([(equal(docs.repartition(5).select("lang", "text", "doc_id")), equal(docs.withColumn("text", F.when(col("doc_id") == 3, "x").otherwise(col("text")))))], "same boolean, other boolean")




@query("srt_08_wait_order", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0) DESC, event_id)::INT AS place FROM events")
def wait_order(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    order = R.wait_order(col("ts"), F.lit(NOW).cast("timestamp"), col("event_id"))
    return events.select("event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(*order)).alias("place"))


@query("win_02_latest_by_time", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def latest_by_time(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("win_04_geometric", "SELECT doc_id, round(pow(0.25, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1), 8) AS weight FROM documents")
def geometric(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.pow(F.lit(0.25), rank - 1), 8).alias("weight"))


@query(
    "sch_21_neighbours",
    """WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT vec_id, other, round(score, 5) AS score FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p.score DESC, other) <= 2""",
)
def neighbours(spark, sf_dir):
    return R.nearest_others(table(spark, sf_dir, "embeddings"), "vec_id", "label", 2).select("vec_id", "other", F.round("score", 5).alias("score"))
