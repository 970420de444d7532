"""Hybrid search over groups of documents, the review queue over orders and their lines, people and proposals: each with a twin from the rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronry.operators import hybrid as H
from heronry.operators import index as I
from heronry.operators import queue as Q
from heronry.operators import search as S
from heronry.plans.base import query, table
from heronry.plans.core import TERMS, TOKENS_CTE
from heronry.plans.indexes import stored_index

col = F.col

# --- hybrid search: four documents are a group whose project is the language of its first; a vector's fingerprint is its label -------------

FOUND = f"""{TOKENS_CTE},
gr AS (SELECT doc_id // 4 AS "group", arg_min(lang, doc_id) AS project, count(*) AS members FROM documents GROUP BY 1),
ls AS (SELECT doc_id // 4 AS "group", round(sum(score * pow(0.25, rn - 1)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY score DESC, doc_id) AS rn FROM scored) GROUP BY 1),
fu AS (SELECT doc_id // 4 AS "group", count(DISTINCT term) = 2 AS "full" FROM tf WHERE term IN ('the', 'of') GROUP BY 1),
lx AS (SELECT "group", project, row_number() OVER (ORDER BY score DESC, "group") AS lexical_rank, coalesce("full", false) AS "full" FROM ls JOIN gr USING ("group") LEFT JOIN fu USING ("group") ORDER BY lexical_rank LIMIT 60),
vq AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
ps AS (SELECT vec_id AS chunk, vec_id // 4 AS "group", project, round(list_cosine_similarity(embedding::DOUBLE[], e), 9) AS score FROM embeddings, vq, gr WHERE gr."group" = vec_id // 4 AND vec_id IN (SELECT doc_id FROM documents) AND vec_id % 9 <> 0),
pc AS (SELECT * FROM ps WHERE score > 0.1),
sg AS (SELECT "group", project, row_number() OVER (ORDER BY max(score) DESC, arg_min(chunk, (-score, chunk))) AS semantic_rank FROM pc GROUP BY 1, 2)"""


def _release(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("doc_id DIV 4").alias("group"))
    projects = docs.groupBy("group").agg(F.min_by("lang", "doc_id").alias("project"))
    vectors = table(spark, sf_dir, "embeddings").select(col("vec_id").alias("doc_id"), "label")
    held = docs.join(vectors, "doc_id").join(projects, "group")
    return held.select(col("doc_id").alias("chunk"), col("label").alias("fingerprint"), "group", "project"), projects


def _lexical(spark, sf_dir):
    _, projects = _release(spark, sf_dir)
    scored = I.scored(spark, stored_index(spark, sf_dir), TERMS).select(col("key").alias("doc_id"), "score", F.expr("key DIV 4").alias("group"))
    groups = S.group_scores(scored, "group", "doc_id").select("group", F.round("score", 6).alias("score"))
    held = I.read_terms(spark, stored_index(spark, sf_dir), ["the", "of"]).groupBy(F.expr("key DIV 4").alias("group")).agg((F.count_distinct("term") == 2).alias("full"))
    order = Window.orderBy(F.desc("score"), "group")
    ranked = groups.join(projects, "group").join(held, "group", "left").withColumn("lexical_rank", F.row_number().over(order))
    return ranked.select("group", "project", "lexical_rank", F.lit(False).alias("exact"), F.coalesce("full", F.lit(False)).alias("full")).filter("lexical_rank <= 60")


def _candidates(spark, sf_dir):
    """What a vector index that lags behind answers: every ninth vector is of an older text."""
    vectors = table(spark, sf_dir, "embeddings")
    score = F.round(S.cosine(col("embedding"), F.array(*map(F.lit, S.first_vector(vectors)))), 9)
    old = F.when(col("vec_id") % 9 == 0, col("label") + 1000).otherwise(col("label"))
    return vectors.select(col("vec_id").alias("chunk"), old.alias("fingerprint"), score.alias("score")).filter("score > 0.1")


@query("sch_10_rechecked", f'WITH {FOUND} SELECT chunk, "group", project, round(score, 6) AS score FROM pc')
def rechecked(spark, sf_dir):
    return H.rechecked(_candidates(spark, sf_dir), _release(spark, sf_dir)[0]).select("chunk", "group", "project", F.round("score", 6).alias("score"))


HYBRID = """lw AS (SELECT * FROM lx WHERE {inside}), sw AS (SELECT "group", project, row_number() OVER (ORDER BY semantic_rank) AS semantic_rank FROM sg WHERE {inside}),
k AS (SELECT *, sum(CASE WHEN "full" THEN 0 ELSE 1 END) OVER (ORDER BY lexical_rank) = 0 AS kept FROM lw),
b AS (SELECT coalesce(k."group", s."group") AS "group", coalesce(k.project, s.project) AS project, lexical_rank, semantic_rank, coalesce(kept, false) AS kept,
  coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) AS score FROM k FULL JOIN sw s ON s."group" = k."group"),
o AS (SELECT *, row_number() OVER (ORDER BY kept DESC, CASE WHEN kept THEN lexical_rank END, score DESC, lexical_rank NULLS LAST, "group") AS rank FROM b)
SELECT "group", project, lexical_rank::INT AS lexical_rank, semantic_rank::INT AS semantic_rank, round(score, 7) AS score, rank::INT AS rank FROM o WHERE rank <= 40"""


@query("sch_07_hybrid", f"WITH {FOUND}, " + HYBRID.replace("{inside}", "project IN ('en', 'fr')"))
def hybrid(spark, sf_dir):
    told = H.hybrid(_lexical(spark, sf_dir), _candidates(spark, sf_dir), _release(spark, sf_dir)[0], 40, ["en", "fr"])
    return told.withColumn("score", F.round("score", 7))


@query("srt_03_kept_ranks", f"WITH {FOUND}, " + HYBRID.replace("{inside}", "true"))
def kept_ranks(spark, sf_dir):
    return H.hybrid(_lexical(spark, sf_dir), _candidates(spark, sf_dir), _release(spark, sf_dir)[0], 40).withColumn("score", F.round("score", 7))


@query("agg_06_merged_facets", f'WITH {FOUND} SELECT project, count(DISTINCT "group") AS groups FROM (SELECT "group", project FROM lx UNION ALL SELECT "group", project FROM sg) GROUP BY project')
def merged_facets(spark, sf_dir):
    passages = H.rechecked(_candidates(spark, sf_dir), _release(spark, sf_dir)[0])
    return H.facets(_lexical(spark, sf_dir), H.semantic_groups(passages))


@query(
    "srt_04_protected_head",
    """WITH r AS (SELECT event_type AS q, event_id AS k, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place, CASE WHEN event_id % 3 = 0 THEN row_number() OVER (PARTITION BY event_type, event_id % 3 ORDER BY event_id) END AS lexical_rank, CASE WHEN event_id % 2 = 0 THEN (event_id % 100) / 100.0 END AS similarity, value FROM events WHERE event_id < 400),
    s AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC NULLS LAST, k) AS sr, count(*) OVER (PARTITION BY q) AS n FROM r), g AS (SELECT *, max(CASE WHEN sr = least(20, n) THEN similarity END) OVER (PARTITION BY q) AS usual FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY value DESC, lexical_rank NULLS LAST, k) AS position FROM g)
    SELECT q, k, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN coalesce(lexical_rank <= 3, false) OR coalesce(similarity >= usual + 0.1, false) THEN 0 ELSE 1 END, position)::INT AS final FROM p""",
)
def protected_head(spark, sf_dir):
    e = col("event_id")
    order = Window.partitionBy("event_type", e % 3).orderBy("event_id")
    rows = table(spark, sf_dir, "events").filter("event_id < 400").select(col("event_type").alias("q"), e.alias("k"), F.when(e % 3 == 0, F.row_number().over(order)).alias("lexical_rank"), F.when(e % 2 == 0, (e % 100) / 100).alias("similarity"), col("value").alias("score"))
    return S.protect_head(rows, "q", "k").select("q", "k", "final")


BROWSED = "SELECT doc_id AS entry, lang AS project, source AS status, coalesce(text, '') AS t, n_chars % 50 AS activity, doc_id * 7 % 1000 AS newest FROM documents WHERE lang = 'en'"


def _entries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(col("doc_id").alias("entry"), col("lang").alias("project"), col("source").alias("status"), F.array("source").alias("tags"), F.coalesce("text", F.lit("")).alias("text"), (col("n_chars") % 50).alias("activity"), (col("doc_id") * 7 % 1000).alias("newest"))


@query(
    "fil_12_browse",
    f"""WITH e AS ({BROWSED}), s AS (SELECT *, (CASE WHEN contains(lower(t), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'license') THEN 1 ELSE 0 END) AS score FROM e)
    SELECT 'hot' AS sort, entry, 0 AS score, row_number() OVER (ORDER BY activity DESC, newest DESC, entry)::INT AS rank FROM e UNION ALL SELECT 'recent', entry, 0, row_number() OVER (ORDER BY newest DESC, entry)::INT FROM e
    UNION ALL SELECT 'relevance', entry, score, row_number() OVER (ORDER BY score DESC, newest DESC, entry)::INT FROM s WHERE score > 0""",
)
def browse(spark, sf_dir):
    sorts = [("hot", ""), ("recent", ""), ("relevance", "The  license")]
    parts = [H.browse(_entries(spark, sf_dir), sort, words, "en").select(F.lit(sort).alias("sort"), "entry", "score", "rank") for sort, words in sorts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "sch_14_feed_chunks",
    """WITH w AS (SELECT doc_id AS record, lang AS "group", list_filter(string_split_regex(trim(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 6 <> 5),
    o AS (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - 180) / 150.0)::BIGINT) + 1)) AS ordinal FROM w WHERE len(w) > 0)
    SELECT "group", record, ordinal::INT AS ordinal, len(w[ordinal * 150 + 1:ordinal * 150 + 180])::INT AS n_words, sha256(array_to_string(w[ordinal * 150 + 1:ordinal * 150 + 180], ' ')) AS chunk FROM o""",
)
def feed_chunks(spark, sf_dir):
    """Entries are languages; every sixth document is in no entry."""
    docs = table(spark, sf_dir, "documents")
    entries = docs.filter("doc_id % 6 <> 5").groupBy(col("lang").alias("group")).agg(F.collect_list("doc_id").alias("records"))
    return H.feed_chunks(entries, docs.select(col("doc_id").alias("record"), "text")).withColumn("chunk", F.sha2(col("chunk").cast("binary"), 256))


@query(
    "sch_16_hydrated",
    """SELECT doc_id AS asked, CASE doc_id % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'stale' WHEN 2 THEN 'unknown' ELSE 'invalid' END AS state, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS record, CASE WHEN doc_id % 4 = 0 THEN sha256(text) END AS text FROM documents""",
)
def hydrated(spark, sf_dir):
    """References to every document: of this revision, of another, to records that are gone, and broken ones."""
    docs, d = table(spark, sf_dir, "documents"), col("doc_id")
    revision, record = F.when(d % 4 == 1, "old").otherwise("r1"), F.when(d % 4 == 2, -1 - d).otherwise(d)
    ref = F.when(d % 4 == 3, F.concat(F.lit("no-ref-"), d)).otherwise(H.detail_ref(revision, d % 7, record))
    asked = docs.select(d.alias("asked"), ref.alias("ref"))
    told = H.hydrated(asked, docs.select((d % 7).alias("group"), d.alias("record"), "text"), "r1")
    return told.join(asked, "ref").select("asked", "state", "record", F.sha2(col("text").cast("binary"), 256).alias("text"))


# --- the review queue: orders are pulls, suppliers of their lines reviewers; a supplier's line of return flag R is the author's own ---------

NOW = "1999-06-01 00:00:00"
PULLS = """p AS (SELECT o_orderkey AS number, 'u' || o_custkey AS author, o_orderkey % 9 = 0 AS draft, CASE WHEN o_orderpriority LIKE '1%' THEN 'APPROVED' END AS decision, o_orderdate AS made, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 200 DAY END AS updated FROM orders WHERE o_orderstatus <> 'F'),
v AS (SELECT l_orderkey AS number, CASE WHEN l_returnflag = 'R' THEN author WHEN l_suppkey % 10 = 0 THEN 'ci[bot]' ELSE 's' || l_suppkey END AS reviewer, l_shipdate AS tm, author FROM lineitem JOIN p ON p.number = l_orderkey),
w AS (SELECT number, count(DISTINCT reviewer) AS reviewers, max(tm) AS last_review FROM v WHERE reviewer <> author AND reviewer NOT LIKE '%[bot]' GROUP BY number),
x AS (SELECT p.*, coalesce(reviewers, 0) AS reviewers, last_review, greatest(made, updated) AS au, greatest(made, updated, last_review) AS since FROM p LEFT JOIN w USING (number)),
y AS (SELECT *, epoch_us(TIMESTAMP '1999-06-01') - epoch_us(since) AS wait, floor((epoch_us(TIMESTAMP '1999-06-01') - epoch_us(since)) / 86400000000.0)::BIGINT AS wait_days, coalesce(last_review >= au, false) AS turn FROM x),
z AS (SELECT *, CASE WHEN draft THEN NULL WHEN decision IS NOT NULL THEN 'approved' WHEN reviewers = 0 AND wait > 7 * 86400000000 THEN 'noReviewer' WHEN reviewers > 0 AND NOT turn AND wait > 7 * 86400000000 THEN 'waiting' END AS bucket FROM y)"""


def _pulls(spark, sf_dir):
    k = col("o_orderkey")
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    updated = F.when(k % 3 == 0, col("o_orderdate") + F.expr("interval 200 days"))
    pulls = orders.select(k.alias("number"), F.concat(F.lit("u"), "o_custkey").alias("author"), (k % 9 == 0).alias("draft"), F.when(col("o_orderpriority").startswith("1"), "APPROVED").alias("decision"), col("o_orderdate").alias("created_at"), updated.alias("updated_at"))
    lines = table(spark, sf_dir, "lineitem").join(pulls.select(col("number").alias("l_orderkey"), "author"), "l_orderkey")
    reviewer = F.when(col("l_returnflag") == "R", col("author")).when(col("l_suppkey") % 10 == 0, "ci[bot]").otherwise(F.concat(F.lit("s"), "l_suppkey"))
    return pulls, lines.select(col("l_orderkey").alias("number"), reviewer.alias("reviewer"), col("l_shipdate").alias("at"))


def _told(spark, sf_dir):
    return Q.classified(*_pulls(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(
    "sch_19_review_queue",
    f"WITH {PULLS} SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY wait_days DESC, number)::INT AS place, number, wait_days FROM z WHERE bucket IS NOT NULL",
)
def review_queue(spark, sf_dir):
    return Q.queue(_told(spark, sf_dir))


@query("agg_32_pull_reasons", f"WITH {PULLS} SELECT coalesce(bucket, CASE WHEN draft THEN 'draft' WHEN reviewers = 0 THEN 'recent-no-reviewer' WHEN turn THEN 'author-turn' ELSE 'recent-review-wait' END) AS state, count(*) AS n, sum(reviewers)::BIGINT AS reviewers FROM z GROUP BY 1")
def pull_reasons(spark, sf_dir):
    return _told(spark, sf_dir).groupBy(F.coalesce("bucket", "reason").alias("state")).agg(F.count("*").alias("n"), F.sum("reviewers").alias("reviewers"))


PROPOSED = "h AS (SELECT CASE WHEN event_type = 'signup' THEN 'vote' ELSE 'discuss' END AS stage, CASE WHEN event_type = 'error' THEN NULL ELSE value > 50 END AS queued FROM events)"


@query("agg_35_queue_counts", f"WITH {PULLS}, {PROPOSED}, a AS (SELECT count_if(bucket = 'noReviewer') AS \"noReviewer\", count_if(bucket = 'waiting') AS waiting, count_if(bucket = 'approved') AS approved, count(bucket) AS prs FROM z), b AS (SELECT count_if(queued AND stage = 'vote') AS vote, count_if(queued AND stage = 'discuss') AS discuss, count_if(queued) AS kips, count_if(queued IS NULL) AS unavailable FROM h) SELECT *, false AS stored_differ FROM a, b")
def queue_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    proposals = events.select(F.when(col("event_type") == "signup", "vote").otherwise("discuss").alias("stage"), F.when(col("event_type") != "error", col("value") > 50).alias("queued"))
    counts = Q.queue_counts(_told(spark, sf_dir), proposals)
    return counts.withColumn("stored_differ", F.lit(Q.counts_differ(counts, counts)))


# --- proposals and the pulls behind their issues: events are threads ------------------------------------------------------------------------


@query(
    "joi_18_proposal_rows",
    """WITH t AS (SELECT event_id AS thread, ts, event_type = 'click' AS is_pull, 'P' || user_id % 30 AS key, 'I' || event_id % 40 AS issue, CASE event_type WHEN 'signup' THEN 'vote' WHEN 'view' THEN 'discuss' END AS tag FROM events WHERE event_id % 5 <> 0),
    o AS (SELECT key, thread, ts, tag AS stage FROM t UNION ALL SELECT key, thread, ts, 'code' FROM t WHERE is_pull UNION ALL SELECT a.key, b.thread, b.ts, 'linked' FROM t a JOIN t b ON a.issue = b.issue WHERE NOT a.is_pull AND b.is_pull),
    g AS (SELECT key, list(DISTINCT stage) FILTER (stage IS NOT NULL) AS s, count(DISTINCT thread) AS cites, max(ts) AS newest FROM o GROUP BY key)
    SELECT key, list_filter(['vote', 'discuss', 'code', 'linked'], lambda x: list_contains(s, x))[1] AS stage, len(s)::INT AS stages, cites::INT AS cites, epoch_us(newest) AS newest_us FROM g WHERE len(s) > 0""",
)
def proposal_rows(spark, sf_dir):
    tag = F.when(col("event_type") == "signup", F.array(F.lit("vote"))).when(col("event_type") == "view", F.array(F.lit("discuss"))).otherwise(F.expr("cast(array() AS array<string>)"))
    threads = table(spark, sf_dir, "events").filter("event_id % 5 <> 0").select(col("event_id").alias("thread"), col("ts").alias("newest"), F.array(F.concat(F.lit("P"), col("user_id") % 30)).alias("keys"), F.array(F.concat(F.lit("I"), col("event_id") % 40)).alias("issues"), tag.alias("tags"), (col("event_type") == "click").alias("is_pull"))
    rows = Q.proposal_counts(threads, ["vote", "discuss", "code", "linked"])
    return rows.select("key", "stage", F.size("stages").alias("stages"), col("cites").cast("int").alias("cites"), F.unix_micros("newest").alias("newest_us"))


@query(
    "joi_13_starter_links",
    """WITH s AS (SELECT DISTINCT user_id AS proposal, 'n' || user_id AS person FROM events WHERE event_type = 'signup'), i AS (SELECT DISTINCT event_id AS issue, user_id AS proposal, 'a' || (user_id + CASE WHEN event_id % 400 = 0 THEN 1 ELSE 0 END) AS account, 'n' || CASE WHEN event_id % 10 = 0 THEN user_id ELSE 100000 + event_id END AS name_key FROM events WHERE event_type <> 'signup'),
    p AS (SELECT person AS mail, account, count(DISTINCT s.proposal) AS proposals FROM s JOIN i ON i.proposal = s.proposal AND i.name_key = s.person GROUP BY 1, 2),
    c AS (SELECT *, count(*) OVER (PARTITION BY mail) AS m, count(*) OVER (PARTITION BY account) AS n FROM p) SELECT mail, account, proposals FROM c WHERE m = 1 AND n = 1""",
)
def starter_links(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    u, e = col("user_id"), col("event_id")
    starters = events.filter("event_type = 'signup'").select(u.alias("proposal"), F.concat(F.lit("n"), u).alias("person")).distinct()
    account, name = u + F.when(e % 400 == 0, 1).otherwise(0), F.when(e % 10 == 0, u).otherwise(100_000 + e)
    issues = events.filter("event_type <> 'signup'").select(e.alias("issue"), u.alias("proposal"), F.concat(F.lit("a"), account).alias("account"), F.concat(F.lit("n"), name).alias("name_key"))
    return Q.starter_links(starters, issues)


@query(
    "joi_22_precision",
    """WITH p AS (SELECT DISTINCT user_id // 3 AS person, CASE user_id % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'j' ELSE 'm' END AS source, user_id AS k FROM events), c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0),
    w AS (SELECT person, CASE WHEN k % 7 = 0 THEN k + 1 ELSE k - k % 3 END AS who FROM p JOIN c USING (k) WHERE source = 'g' UNION ALL SELECT person, CASE WHEN k % 7 = 0 THEN k + 1 ELSE k - k % 3 END FROM p JOIN c USING (k) WHERE source <> 'g'),
    n AS (SELECT person, count(DISTINCT who) AS n FROM w GROUP BY person) SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'agree' ELSE 'differ' END AS verdict, count(*) AS n FROM (SELECT DISTINCT person FROM p) LEFT JOIN n USING (person) GROUP BY 1""",
)
def precision(spark, sf_dir):
    """Accounts and names are numbers; a committer has the login of its family, so that a person's three identities may agree."""
    u, k = col("user_id"), col("c_custkey")
    persons = table(spark, sf_dir, "events").select(F.expr("user_id DIV 3").alias("person"), F.when(u % 3 == 0, "g").when(u % 3 == 1, "j").otherwise("m").alias("source"), u.alias("name")).distinct()
    known = table(spark, sf_dir, "customer").filter(k % 4 != 0).select(k.alias("name"), F.when(k % 7 == 0, k + 1).otherwise(k - k % 3).alias("who"))
    # The login side is looked up by the account itself: accounts stand under their own number in both columns here.
    logins = known.select(col("name").alias("login"), "who")
    by_login = persons.filter("source = 'g'").join(logins, col("name") == col("login")).select("person", "source", col("who").alias("name"))
    by_name = persons.filter("source <> 'g'").join(known, "name").select("person", "source", col("who").alias("name"))
    rest = persons.select("person", F.lit("g").alias("source"), F.lit(-1).cast("long").alias("name"))
    everyone = by_login.unionByName(by_name).unionByName(rest)
    committers = known.select(col("who").alias("name"), col("who").alias("login")).distinct()
    return Q.precision(everyone, committers)


# --- people ------------------------------------------------------------------------------------------------------------------------------------


@query("sch_15_person_search", "WITH r AS (SELECT lower('S' || l_suppkey) AS login, l_shipdate AS tm FROM lineitem), p AS (SELECT DISTINCT login FROM r WHERE tm > TIMESTAMP '1998-06-01' AND tm <= TIMESTAMP '1999-06-01') SELECT login, row_number() OVER (ORDER BY CASE WHEN login = 's1' THEN 0 WHEN login LIKE 's1%' THEN 1 ELSE 2 END, login)::INT AS place FROM p WHERE contains(login, 's1') QUALIFY place <= 20")
def person_search(spark, sf_dir):
    reviews = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("reviewer"), col("l_shipdate").alias("at"))
    return Q.person_search(Q.people(reviews, F.lit(NOW).cast("timestamp")), " @S1 ", 20)


@query(
    "agg_25_activity_view",
    """WITH a AS (SELECT l_orderkey AS thread, 's' || l_suppkey AS person, l_shipdate AS tm, l_returnflag AS area FROM lineitem), m AS (SELECT DISTINCT thread FROM a WHERE person = 's1')
    SELECT thread, count_if(person = 's1') AS records, epoch_us(max(tm) FILTER (person = 's1')) AS newest_us, array_to_string(list_sort(list(DISTINCT area) FILTER (person = 's1')), ',') AS areas, coalesce(array_to_string(list_sort(list(DISTINCT person) FILTER (person <> 's1')), ','), '') AS others FROM a JOIN m USING (thread) GROUP BY thread""",
)
def activity_view(spark, sf_dir):
    activity = table(spark, sf_dir, "lineitem").select(col("l_orderkey").alias("thread"), F.concat(F.lit("s"), "l_suppkey").alias("person"), col("l_shipdate").alias("at"), col("l_returnflag").alias("area"))
    view = Q.activity_view(activity, "s1")
    return view.select("thread", "records", F.unix_micros("newest").alias("newest_us"), F.array_join("areas", ",").alias("areas"), F.array_join("others", ",").alias("others"))
