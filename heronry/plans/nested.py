"""Queries over nested and linked records that are made from the test tables: trees, pages, vault files, evaluation sets, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.operators import identity as N
from heronry.operators import monitoring as M
from heronry.operators import records as R
from heronry.plans.applied import BASE, base
from heronry.plans.base import query, table
from heronry.sources import listings as L

col = F.col

# --- threads as trees: the first turn is the root, the second its child, the others answer the second -----------------------------------


def _trees(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.col("role").alias("body"), F.struct(F.col("role").alias("id")).alias("author")).alias("m"))
    of = lambda test: F.max(F.when(test, col("m")))
    rest = F.transform(F.array_sort(F.collect_list(F.when(col("turn") > 1, F.struct("turn", "m")))), lambda x: x["m"])
    threads = turns.groupBy("conv_id").agg(of(col("turn") == 0).alias("root"), of(col("turn") == 1).alias("second"), rest.alias("rest"))
    node = lambda c, children: F.struct(f"{c}.*", children.alias("children"))
    tree = node("root", F.when(col("second").isNotNull(), F.array(node("second", col("rest")))))
    return threads.filter("root IS NOT NULL").select(col("conv_id").alias("thread"), F.to_json(tree).alias("tree"))


ROOTED = "r AS (SELECT * FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) AND (turn <= 1 OR conv_id IN (SELECT conv_id FROM conversations WHERE turn = 1)))"


@query("src_13_thread_tree", f"WITH {ROOTED} SELECT conv_id AS thread, least(turn, 2)::INT AS depth, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place, conv_id || '-' || turn AS id, role AS body FROM r")
def thread_tree(spark, sf_dir):
    spark.udtf.register("flat_thread", L.FlatThread)
    return spark.sql("SELECT thread, f.* FROM {t}, LATERAL flat_thread(tree) f", t=_trees(spark, sf_dir))


@query("ops_22_message_counts", f"WITH {ROOTED} SELECT conv_id AS thread, count(*) AS messages FROM r GROUP BY conv_id")
def message_counts(spark, sf_dir):
    return R.message_counts(_trees(spark, sf_dir), "thread", "tree")


# --- pages of reviews: twenty pages of users, the first user of each page has failed -----------------------------------------------------


@query("src_09_review_page", "SELECT user_id AS number, event_id::VARCHAR AS id, upper(event_type) AS state, CASE WHEN event_type <> 'error' THEN 'a' || event_id % 7 END AS author FROM events WHERE user_id NOT IN (SELECT min(user_id) FROM events GROUP BY user_id % 20)")
def review_page(spark, sf_dir):
    author = F.when(col("event_type") != "error", F.concat(F.lit("a"), col("event_id") % 7))
    review = F.struct(col("event_id").cast("string").alias("id"), F.upper("event_type").alias("state"), author.alias("author"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(review).alias("reviews"))
    nodes = F.array_sort(F.collect_list(F.struct(col("user_id").alias("number"), "reviews")))
    pages = users.groupBy((col("user_id") % 20).alias("page")).agg(nodes.alias("nodes"))
    error = F.array(F.struct(F.array(F.lit("repository"), F.lit("nodes"), F.lit("0")).alias("path"), F.lit("gone").alias("message")))
    data = F.struct(F.struct(F.struct(col("nodes").alias("nodes")).alias("repository")).alias("data"), error.alias("errors"))
    return L.review_page(pages.select(F.to_json(F.struct(data["data"].alias("data"), data["errors"].alias("errors"))).alias("body")), "body")


# --- pages of people and proposals ------------------------------------------------------------------------------------------------------


@query("src_15_committers", "SELECT c_name AS name, c_custkey::VARCHAR AS login FROM customer")
def committers(spark, sf_dir):
    row = F.format_string("<tr><td> %s </td><td><a href='https://h/%s'>%s</a></td></tr>", "c_name", "c_custkey", "c_custkey")
    pages = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.concat_ws("\n", F.collect_list(row)).alias("html"))
    return L.committers(pages, "html", r"<tr><td>([^<]+)</td><td><a[^>]*>([^<]+)</a>")


@query("src_18_proposal_links", f"WITH {BASE}, t AS (SELECT doc_id % 50 AS number, CASE WHEN doc_id % 2 = 0 THEN w1 ELSE w1 || ' ' || w2 END AS title FROM b) SELECT number::INT AS number, arg_max(title, (length(title), title)) AS title FROM t GROUP BY number")
def proposal_links(spark, sf_dir):
    number = (col("doc_id") % 50).cast("string")
    link = F.concat(F.lit("<a href='/x'>KIP-"), number, F.lit(" "), "w1", F.lit("</a>"))
    item = F.concat(F.lit("<p>x</p><li>KIP-"), number, F.lit(" "), "w1", F.lit(" "), "w2", F.lit("</li>"))
    pages = base(spark, sf_dir).select(F.when(col("doc_id") % 2 == 0, link).otherwise(item).alias("html"))
    return L.proposal_links(pages, "html", [r">KIP-(\d+)( [^<]+)</a>", r"<li>KIP-(\d+)( [^<]+)</li>"])


def _vault(spark, sf_dir):
    body = F.format_string("---\nid: k%d\ntitle: %s: %s\nrelated: k%d, k%d\n---\n# Head\n\n## Summary\nAbout %s.\n\n## More\nx\n", "doc_id", "w1", "w2", col("doc_id") + 1, col("doc_id") * 2, "w3")
    files = base(spark, sf_dir).select(F.concat(F.lit("f"), "doc_id", F.lit(".md")).alias("path"), body.alias("body"))
    return L.front_matter(files, "body")


@query("src_17_front_matter", f"WITH {BASE} SELECT concat('f', doc_id, '.md') AS path, concat('k', doc_id) AS id, w1 || ': ' || w2 AS title, 'About ' || w3 || '.' AS summary FROM b")
def vault(spark, sf_dir):
    return _vault(spark, sf_dir).select("path", col("fields")["id"].alias("id"), col("fields")["title"].alias("title"), col("sections")["Summary"].alias("summary"))


@query("src_17_unresolved", "SELECT concat('f', doc_id, '.md') AS path, concat('k', other) AS id FROM (SELECT doc_id, unnest([doc_id + 1, doc_id * 2]) AS other FROM documents) WHERE other NOT IN (SELECT doc_id FROM documents)")
def unresolved(spark, sf_dir):
    return L.unresolved(_vault(spark, sf_dir))


# --- chains of parents: tens of documents, six in a chain, two in a cycle, one without its parent, one under another scope's ----------------


@query(
    "joi_03_faulty_chains",
    """SELECT doc_id AS id, CASE WHEN doc_id % 10 < 6 THEN doc_id - doc_id % 10 END AS root, CASE doc_id % 10 WHEN 6 THEN 'cycle' WHEN 7 THEN 'cycle' WHEN 8 THEN 'missing' WHEN 9 THEN 'scope' ELSE 'ok' END AS state
    FROM documents WHERE doc_id - doc_id % 10 + 9 <= (SELECT max(doc_id) FROM documents)""",
)
def faulty_chains(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(col("doc_id").alias("id"))
    last, k = docs.agg(F.max("id")).first()[0], col("id") % 10
    parent = F.when(k == 0, None).when(k < 6, col("id") - 1).when(k == 6, col("id") + 1).when(k == 7, col("id") - 1).when(k == 8, F.lit(-1)).otherwise(col("id") - 9)
    rows = docs.filter(col("id") - k + 9 <= last).select("id", parent.cast("long").alias("parent"), F.when(k == 9, "b").otherwise("a").alias("scope"))
    return R.parent_roots(rows, "id", "parent", "scope")


# --- evaluation sets, diagnoses, books and declared links -------------------------------------------------------------------------------------

JUDGED = "j AS (SELECT 'q' || doc_id % 50 AS query, doc_id AS chunk, CASE WHEN doc_id % 41 = 0 THEN -1 WHEN doc_id % 50 = 7 THEN 0 ELSE quality END AS grade FROM labels), k AS (SELECT DISTINCT 'q' || doc_id % 45 AS query FROM documents), c AS (SELECT doc_id AS chunk FROM documents WHERE doc_id % 13 <> 0)"


@query(
    "ops_15_golden_issues",
    f"""WITH {JUDGED} SELECT DISTINCT query, 'unknown query' AS issue FROM j WHERE query NOT IN (SELECT query FROM k) UNION ALL SELECT DISTINCT query, 'unknown chunk' FROM j WHERE chunk NOT IN (SELECT chunk FROM c)
    UNION ALL SELECT DISTINCT query, 'grade' FROM j WHERE grade < 0 UNION ALL SELECT query, 'nothing relevant' FROM k WHERE query NOT IN (SELECT query FROM j WHERE grade > 0)""",
)
def golden_issues(spark, sf_dir):
    d, docs = col("doc_id"), table(spark, sf_dir, "documents")
    grade = F.when(d % 41 == 0, -1).when(d % 50 == 7, 0).otherwise(col("quality"))
    judged = table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), d % 50).alias("query"), d.alias("chunk"), grade.alias("grade"))
    return M.golden_issues(docs.select(F.concat(F.lit("q"), d % 45).alias("query")).distinct(), judged, docs.filter(d % 13 != 0).select(d.alias("chunk")))


@query(
    "ops_23_graded",
    """WITH e AS (SELECT DISTINCT user_id, event_id % 10 AS k FROM events WHERE event_type <> 'error'), f AS (SELECT DISTINCT user_id, event_id % 10 AS k FROM events WHERE event_type IN ('error', 'click')),
    b AS (SELECT user_id, e.k IS NOT NULL AS wanted, f.k IS NOT NULL AS got FROM e FULL JOIN f USING (user_id, k))
    SELECT user_id AS "case", round(count_if(wanted AND got) / nullif(count_if(wanted), 0), 6) AS recall, round(count_if(wanted AND got) / nullif(count_if(got), 0), 6) AS precision FROM b GROUP BY user_id""",
)
def graded(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(col("user_id").alias("case"), (col("event_id") % 10).alias("evidence"), "event_type")
    told = M.graded(rows.filter("event_type IN ('error', 'click')"), rows.filter("event_type <> 'error'"))
    return told.select("case", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(
    "ops_24_sections",
    """WITH h AS (SELECT DISTINCT user_id AS book, event_type AS section FROM events WHERE value > 40), w AS (SELECT DISTINCT user_id AS book FROM events)
    SELECT book, 'no section ' || section AS issue FROM w, (VALUES ('click'), ('error')) r(section) WHERE (book, section) NOT IN (SELECT book, section FROM h)
    UNION ALL SELECT book, 'no target ' || target FROM (SELECT DISTINCT user_id AS book, event_type AS target FROM events WHERE value < 5) WHERE (book, target) NOT IN (SELECT book, section FROM h)""",
)
def sections(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(col("user_id").alias("book"), "event_type", "value")
    held = events.filter("value > 40").select("book", col("event_type").alias("section")).distinct()
    anchors = events.filter("value < 5").select("book", col("event_type").alias("target")).distinct()
    return M.section_issues(events.select("book").distinct(), held, anchors, ["click", "error"])


@query(
    "ops_27_link_issues",
    """WITH l AS (SELECT event_id, user_id AS a, event_id % 37 AS b FROM events), k AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 6 <> 5),
    n AS (SELECT *, count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) AS n FROM l)
    SELECT a, b, CASE WHEN a = b THEN 'self' WHEN a NOT IN (SELECT id FROM k) OR b NOT IN (SELECT id FROM k) THEN 'unknown' ELSE 'repeat' END AS issue FROM n
    WHERE a = b OR a NOT IN (SELECT id FROM k) OR b NOT IN (SELECT id FROM k) OR n > 1""",
)
def link_issues(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    declared = events.select(col("user_id").alias("a"), (col("event_id") % 37).alias("b"))
    return M.link_issues(declared, events.filter("user_id % 6 <> 5").select(col("user_id").alias("id")).distinct())


# --- identities: users have accounts at three sources, declared links between two of them, and links that events corroborate ---------------

IDENTITIES = """u AS (SELECT DISTINCT user_id FROM events),
i AS (SELECT s || ':' || user_id AS id, s AS source, user_id FROM u, (VALUES ('g'), ('j'), ('m')) v(s)),
dl AS (SELECT 'g:' || user_id AS a, 'j:' || user_id AS b FROM u WHERE user_id % 2 = 0),
cl AS (SELECT DISTINCT 'j:' || user_id AS a, 'm:' || (user_id - user_id % 7 % 2) AS b FROM events WHERE value > 60 AND user_id - user_id % 7 % 2 IN (SELECT user_id FROM u)),
db(x, y) AS (SELECT a, b FROM dl UNION SELECT b, a FROM dl UNION SELECT id, id FROM i),
ba AS (SELECT x AS id, min(y) AS base FROM db GROUP BY x),
ce AS (SELECT p.base AS a, q.base AS b FROM cl JOIN ba p ON p.id = cl.a JOIN ba q ON q.id = cl.b),
cb AS (SELECT a, b FROM ce UNION SELECT b, a FROM ce),
re(x, y) AS (SELECT DISTINCT base, base FROM ba UNION SELECT re.x, cb.b FROM re JOIN cb ON cb.a = re.y),
pe AS (SELECT x AS base, min(y) AS person FROM re GROUP BY x),
me AS (SELECT i.id, source, base, person FROM i JOIN ba USING (id) JOIN pe USING (base)),
co AS (SELECT person, max(n) > 1 AS conflict FROM (SELECT person, source, count(DISTINCT base) AS n FROM me GROUP BY 1, 2) GROUP BY 1)"""


@query("gra_04_identity_links", f"WITH RECURSIVE {IDENTITIES} SELECT id, CASE WHEN conflict THEN base ELSE person END AS person, conflict FROM me JOIN co USING (person)")
def identity_links(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    users, u = events.select("user_id").distinct(), col("user_id")
    name = lambda source, who: F.concat(F.lit(f"{source}:"), who)
    identities = users.select("user_id", F.explode(F.array(F.lit("g"), F.lit("j"), F.lit("m"))).alias("source")).select(F.concat("source", F.lit(":"), "user_id").alias("id"), "source")
    declared = users.filter(u % 2 == 0).select(name("g", u).alias("a"), name("j", u).alias("b"))
    other = u - u % 7 % 2
    seen = events.filter("value > 60").select("user_id", other.alias("other")).distinct().join(users.select(u.alias("other")), "other", "left_semi")
    return N.identity_links(identities, declared, seen.select(name("j", u).alias("a"), name("m", col("other")).alias("b")))
