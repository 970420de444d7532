"""Queries that write releases, monthly tables, indexes and exports to scratch storage and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.functions import calendar as C
from heronry.functions import text as T
from heronry.operators import index as I
from heronry.operators import search as S
from heronry.plans.base import query, table
from heronry.plans.core import TERMS, TOKENS_CTE
from heronry.plans.indexes import stored_index
from heronry.scratch import scratch_path
from heronry.sinks import release as R

TOP = f"WITH {TOKENS_CTE} SELECT doc_id AS key, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20"


@query("sch_05_stored_index", TOP)
def stored(spark, sf_dir):
    return I.search_index(spark, stored_index(spark, sf_dir), TERMS, 20).select("key", F.round("score", 6).alias("score"))


@query("sch_04_two_phases", TOP)
def two_phases(spark, sf_dir):
    return I.search_shards(spark, stored_index(spark, sf_dir), TERMS, 20).select("key", F.round("score", 6).alias("score"))


@query("snk_02_index_terms", f"WITH {TOKENS_CTE.split('stats AS')[0].rstrip().rstrip(',')} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM tok GROUP BY term")
def index_terms(spark, sf_dir):
    return I.read_postings(spark, stored_index(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("sch_08_lexical_fallback", f"WITH {TOKENS_CTE} SELECT doc_id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 7) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 50")
def lexical_fallback(spark, sf_dir):
    from pyspark.sql import Window

    lexical = I.search_index(spark, stored_index(spark, sf_dir), TERMS, 50).withColumnRenamed("key", "doc_id")
    lexical = lexical.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    nothing = lexical.filter("false").select("doc_id", "rank")
    return S.fuse(lexical, nothing, "doc_id").select("doc_id", F.round("score", 7).alias("score"))


RECORDS = """r AS (SELECT doc_id AS record, lang AS tag, source AS author, split_part(coalesce(text, ''), chr(10), 1) AS title, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS body FROM documents),
k AS (SELECT *, regexp_extract_all(lower(title), '[a-z0-9]+') AS kt, regexp_extract_all(lower(body), '[a-z0-9]+') AS kb, regexp_extract_all(lower(tag), '[a-z0-9]+') AS kg, regexp_extract_all(lower(author), '[a-z0-9]+') AS ka FROM r),
c AS (SELECT record, kt, kb, 4 * len(kt) + len(kb) + 2 * len(kg) + len(ka) AS length,
  4 * len(list_filter(kt, lambda x: x = 'of')) + len(list_filter(kb, lambda x: x = 'of')) + 2 * len(list_filter(kg, lambda x: x = 'of')) + len(list_filter(ka, lambda x: x = 'of')) AS f1,
  4 * len(list_filter(kt, lambda x: x = 'the')) + len(list_filter(kb, lambda x: x = 'the')) + 2 * len(list_filter(kg, lambda x: x = 'the')) + len(list_filter(ka, lambda x: x = 'the')) AS f2 FROM k),
s AS (SELECT count(*) AS n, avg(length) AS m, count_if(f1 > 0) AS d1, count_if(f2 > 0) AS d2 FROM c WHERE length > 0),
i AS (SELECT *, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) AS i1, ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) AS i2 FROM s),
w AS (SELECT record, i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * length / m)) + i2 * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * length / m)) AS bm,
  CASE WHEN f1 > 0 AND f2 > 0 THEN (CASE WHEN contains(' ' || array_to_string(kt, ' ') || ' ', ' of the ') THEN 4.0 WHEN contains(' ' || array_to_string(kb, ' ') || ' ', ' of the ') THEN 1.0 ELSE 0.0 END) * (i1 + i2) / 2 ELSE 0 END AS bonus
  FROM c, i WHERE f1 > 0 OR f2 > 0)"""


def _records(spark, sf_dir):
    title = F.substring_index(T.text("text"), "\n", 1)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record"), "source", title.alias("title"), F.expr("substring(coalesce(text, ''), length(substring_index(coalesce(text, ''), '\\n', 1)) + 2)").alias("body"), F.array("lang").alias("tags"), F.col("source").alias("author"))


@query("mat_03_phrase_bonus", f"WITH {RECORDS} SELECT record, round(bm + bonus, 5) AS score FROM w")
def phrase_bonus(spark, sf_dir):
    return I.ranked_records(_records(spark, sf_dir), "of the", tokens=T.simple_tokens, words=T.simple_tokens).select("record", F.round("score", 5).alias("score"))


@query("fil_01_filtered_search", f"WITH {RECORDS} SELECT record, round(bm + bonus, 5) AS score FROM w WHERE record IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src3') AND lang = 'en')")
def filtered_search(spark, sf_dir):
    wanted = S.Filters(sources=("src0", "src3"), tags=("en",))
    return I.ranked_records(_records(spark, sf_dir), "of the", wanted, T.simple_tokens, T.simple_tokens).select("record", F.round("score", 5).alias("score"))


@query("snk_01_content_addressed", "SELECT sha256(coalesce(text, '')) AS sha256, strlen(coalesce(any_value(text), ''))::BIGINT AS bytes, count(*) AS uses, min(doc_id) AS first_key FROM documents GROUP BY 1")
def content_addressed(spark, sf_dir):
    path = scratch_path(spark, "release")
    R.write_release(table(spark, sf_dir, "documents"), "doc_id", T.text("text"), path)
    return R.read_release(spark, path).groupBy("sha256").agg(F.any_value("bytes").alias("bytes"), F.count("*").alias("uses"), F.min("key").alias("first_key"))


def _objects(spark, sf_dir, changed: bool):
    """Pages as objects: in the changed set every url whose digest begins with 0 is gone and with 1 has other content."""
    pages = table(spark, sf_dir, "pages")
    mark = F.substring(R.digest(F.col("url")), 1, 1)
    body = F.concat(T.text("html"), F.when((mark == "1") & F.lit(changed), "~").otherwise(""))
    rows = pages.select(F.col("page_id").alias("key"), R.digest(body).alias("sha256"), F.octet_length(body).alias("bytes"), mark.alias("m"))
    return rows.filter(F.col("m") != "0").drop("m") if changed else rows.drop("m")


MARK = "substr(sha256(coalesce(url, '')), 1, 1)"


@query("snk_03_publish", "SELECT true AS first, false AS again, true AS next, 'r2' AS current")
def publish(spark, sf_dir):
    pointer, whole = f"{scratch_path(spark, 'pointer')}/current.json", _objects(spark, sf_dir, False)
    fine = R.verification(whole, whole)
    states = [R.publish(spark, pointer, release, fine) for release in ("r1", "r1", "r2")]
    return spark.createDataFrame([(*states, R.read_pointer(spark, pointer)["release"])], "first boolean, again boolean, next boolean, current string")


@query("snk_04_promotion", f"SELECT count_if({MARK} = '1') AS copied, count_if({MARK} NOT IN ('0', '1')) AS reused FROM pages")
def promotion(spark, sf_dir):
    return R.promotion(_objects(spark, sf_dir, True), _objects(spark, sf_dir, False))


@query("snk_05_put_states", f"SELECT page_id AS key, CASE {MARK} WHEN '0' THEN 'written' WHEN '1' THEN 'conflict' ELSE 'reused' END AS state FROM pages")
def put_states(spark, sf_dir):
    return R.put_states(_objects(spark, sf_dir, False), _objects(spark, sf_dir, True))


@query("snk_06_verification", f"SELECT page_id AS key, CASE {MARK} WHEN '0' THEN 'missing' ELSE 'length' END AS problem FROM pages WHERE {MARK} IN ('0', '1')")
def verification(spark, sf_dir):
    return R.verification(_objects(spark, sf_dir, False), _objects(spark, sf_dir, True))


@query("snk_07_manifest", f"SELECT page_id AS key, 'absent' AS issue FROM pages WHERE {MARK} = '0'")
def manifest(spark, sf_dir):
    return R.manifest_issues(_objects(spark, sf_dir, False), _objects(spark, sf_dir, True))


@query("snk_08_months", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, round(sum(CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END), 4) AS total FROM events GROUP BY 1")
def months(spark, sf_dir):
    path, events = scratch_path(spark, "months"), table(spark, sf_dir, "events")
    rows = events.select(C.month(F.col("ts")).alias("month"), "event_id", "value", F.lit(0).alias("revision"))
    again = rows.filter("event_id % 3 = 0").select("month", "event_id", (F.col("value") + 1).alias("value"), F.lit(1).alias("revision"))
    for part in (rows.filter("event_id % 2 = 0"), rows, again, rows):
        R.upsert_months(spark, part, path, ["event_id"], ["revision"])
    kept = R.read_months(spark, path)
    return (rows if kept is None else kept).groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("snk_09_verdicts", "SELECT event_id AS review_id, CASE WHEN event_id % 4 = 0 THEN 'DISMISSED' ELSE upper(event_type) END AS state, upper(event_type) AS verdict FROM events")
def verdicts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), F.upper("event_type").alias("state"), F.lit(None).cast("string").alias("verdict"), "ts")
    old = events.select("review_id", "state", "verdict", F.col("ts").alias("at"))
    new = events.filter("review_id % 4 = 0").select("review_id", F.lit("DISMISSED").alias("state"), "verdict", (F.col("ts") + F.expr("interval 1 day")).alias("at"))
    return R.merged_verdicts(old, new).select("review_id", "state", "verdict")


@query("snk_10_state_delta", f"SELECT page_id AS key, CASE {MARK} WHEN '0' THEN 'delete' ELSE 'put' END AS action FROM pages WHERE {MARK} IN ('0', '1')")
def state_delta(spark, sf_dir):
    return R.state_delta(_objects(spark, sf_dir, False), _objects(spark, sf_dir, True), "key", "sha256")


@query("snk_11_vector_delta", "SELECT vec_id, 'put' AS action FROM embeddings WHERE label = 1 UNION ALL SELECT vec_id, 'delete' FROM embeddings WHERE label = 0")
def vector_delta(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.sha2(F.to_json("embedding"), 256).alias("mark"))
    new = vectors.filter("label <> 0").withColumn("mark", F.when(F.col("label") == 1, F.reverse("mark")).otherwise(F.col("mark")))
    return R.state_delta(vectors, new, "vec_id", "mark")


@query("snk_12_json_export", "SELECT page_id, url FROM pages")
def json_export(spark, sf_dir):
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "pages").select("page_id", "url", F.pmod("page_id", F.lit(8)).alias("part")).write.partitionBy("part").json(path)
    return spark.read.schema("page_id long, url string, part int").json(path).select("page_id", "url")


@query(
    "snk_13_equal_bytes",
    """SELECT event_type, sha256(string_agg('{"event_id":' || event_id || ',"user_id":' || user_id || '}', chr(10) ORDER BY event_id)) AS sha256 FROM events GROUP BY event_type""",
)
def equal_bytes(spark, sf_dir):
    return R.encoded(table(spark, sf_dir, "events"), "event_type", ["event_id"], ["user_id", "event_id"]).select("event_type", "sha256")


@query("snk_14_metric_points", "SELECT event_type AS job, count(*) AS n, max(event_id)::VARCHAR AS newest FROM events GROUP BY event_type")
def metric_points(spark, sf_dir):
    path, events = scratch_path(spark, "points"), table(spark, sf_dir, "events")
    runs = events.select(F.col("event_type").alias("job"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("at"), F.lit("ok").alias("status"), F.create_map(F.lit("value"), F.col("value")).alias("values"), "event_id")
    for half in (0, 1):
        R.metric_point(spark, path, runs.filter(F.col("event_id") % 2 == half))
    return spark.read.parquet(path).groupBy("job").agg(F.count("*").alias("n"), F.max_by("run_id", "at").alias("newest"))
