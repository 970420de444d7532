"""Fusion, queues, votes and gates on nulls, ties, repeats and empty inputs."""

import pytest
from pyspark.sql import functions as F

from heronry.operators import activity, contracts, hybrid, queue
from tests.plan_rows import rows_of_joins

LEXICAL = "group long, project string, lexical_rank int, exact boolean, full boolean"
SEMANTIC = "group long, project string, semantic_rank int, semantic_score double, chunks array<long>"


def order(df):
    return [r.group for r in df.orderBy("rank").collect()]


def test_leading_full_matches_keep_their_places(spark):
    lexical = spark.createDataFrame([(1, "p", 1, False, True), (2, "p", 2, False, True), (3, "p", 3, False, False), (4, "p", 4, False, True), (5, "p", 5, True, False)], LEXICAL)
    semantic = spark.createDataFrame([(4, "p", 1, 0.9, [40]), (9, "p", 2, 0.8, [90])], SEMANTIC)
    assert order(hybrid.fused(lexical, semantic)) == [5, 1, 2, 4, 9, 3]
    assert order(hybrid.fused(lexical, semantic, hybrid.Fusion(keep_leading=False))) == [5, 4, 1, 2, 9, 3]
    assert order(hybrid.fused(lexical.limit(0), semantic)) == [4, 9]
    assert order(hybrid.hybrid(lexical, None, semantic, 2)) == [1, 2]
    with pytest.raises(Exception, match="two projects"):
        hybrid.fused(lexical, semantic.withColumn("project", F.lit("q"))).collect()
    with pytest.raises(ValueError):
        hybrid.Fusion(k=0)


def test_passages_that_the_release_lacks_do_not_count(spark):
    release = spark.createDataFrame([(1, "a", 10, "p"), (2, "b", 10, "p"), (3, "c", 11, "p")], "chunk long, fingerprint string, group long, project string")
    found = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.5), (2, "old", 0.9), (3, "c", 0.5), (8, "a", 1.0)], "chunk long, fingerprint string, score double")
    groups = hybrid.semantic_groups(hybrid.rechecked(found, release)).orderBy("semantic_rank").collect()
    assert [(r.group, r.semantic_rank, r.chunks) for r in groups] == [(10, 1, [1]), (11, 2, [3])]


def test_pulls_without_reviews_and_own_reviews(spark):
    at = lambda d: F.lit(d).cast("timestamp")
    rows = [(1, "ada", False, None, "2024-01-01", None), (2, "ada", True, None, "2024-01-01", None), (3, "x[bot]", False, "APPROVED", "2024-01-01", None), (4, "bo", False, None, "2024-01-01", "2024-01-05"), (5, "bo", False, None, "2024-01-29", None), (6, "bo", False, "APPROVED", "2024-01-29", None), (7, "bo", False, None, "2024-01-01", None)]
    pulls = spark.createDataFrame(rows, "number int, author string, draft boolean, decision string, created_at string, updated_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})
    reviews = spark.createDataFrame([(1, "ada", "2024-01-02"), (1, "ci[bot]", "2024-01-02"), (4, "cy", "2024-01-03"), (4, "cy", "2024-01-04"), (7, "cy", "2024-01-20")], "number int, reviewer string, at string").withColumn("at", F.col("at").cast("timestamp"))
    told = {r.number: (r.reviewers, r.bucket or r.reason) for r in queue.classified(pulls, reviews, at("2024-02-01")).collect()}
    assert told == {1: (0, "noReviewer"), 2: (0, "draft"), 3: (0, "machine-author"), 4: (1, "waiting"), 5: (0, "recent-no-reviewer"), 6: (0, "approved"), 7: (1, "author-turn")}
    proposals = spark.createDataFrame([("vote", True), ("discuss", None)], "stage string, queued boolean")
    counts = queue.queue_counts(queue.classified(pulls, reviews, at("2024-02-01")), proposals)
    assert counts.first().asDict() == {"noReviewer": 1, "waiting": 1, "approved": 1, "prs": 3, "vote": 1, "discuss": 0, "kips": 1, "unavailable": 1}
    assert queue.counts_differ(counts, counts.withColumn("prs", F.lit(4))) and not queue.counts_differ(counts, counts)


def test_last_votes_count(spark):
    votes = spark.createDataFrame([("t", "a", 1, "+1", True), ("t", "a", 2, "-1", True), ("t", "b", 1, "+1", False), ("u", "a", 1, "+1", True), ("u", "b", 1, "+1", True), ("u", "c", 1, "+1", True), ("u", "c", 1, "+1", True), (None, "c", 1, "0", None)], "topic string, voter string, n int, vote string, member boolean")
    told = {r.topic: (r.plus_one, r.minus_one, r.binding, r.state) for r in activity.vote_tally(votes, "topic", "voter", ["n"], "vote", "member", "+1", "-1").collect()}
    assert told == {"t": (1, 1, 0, "vetoed"), "u": (3, 0, 3, "passing"), None: (0, 0, 0, "open")}


def test_payloads_by_contract(spark):
    rows = [("c", '{"n":1,"s":"x","b":true}'), ("c", '{"n":"1","s":2}'), ("c", "{broken"), ("c", None), ("z", "{}"), (None, None)]
    told = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<k: string, p: string>").select("i", contracts.payload_issues(F.col("r.k"), F.col("r.p"), {"c": {"n": "number", "s": "string", "b": "boolean"}}).alias("x"))
    got = {r.i: r.x for r in told.collect()}
    assert got == {0: [], 1: ["n must be a number", "s must be a string", "b must be a boolean"], 2: ["payload must be an object"], 3: ["payload must be an object"], 4: ["unknown contract"], 5: ["unknown contract"]}


def test_an_issue_that_many_threads_name_meets_its_pulls_once(spark):
    rows = spark.range(6000).select(F.col("id").alias("thread"), F.col("id").cast("timestamp").alias("newest"), F.array(F.lit("P")).alias("keys"), F.array(F.lit("I"), F.lit("I")).alias("issues"), F.expr("cast(array() AS array<string>)").alias("tags"), (F.col("id") % 2 == 0).alias("is_pull"))
    rows = rows.union(spark.sql("SELECT 9001L, timestamp '2024-01-01', array('Q', 'Q'), array('I', 'J'), array('vote', 'other', null), false UNION ALL SELECT 9002L, null, array('R'), array('J'), array(), false"))
    met = []
    for count in (queue.proposal_counts, queue.proposal_rows):
        df = count(rows, ["vote", "code", "linked"])
        got = {r.key: r for r in df.collect()}
        met.append({k: (r.stage, r.stages, r.cites if isinstance(r.cites, int) else len(r.cites)) for k, r in got.items()})
    assert met[0] == met[1] == {"P": ("code", ["code", "linked"], 6000), "Q": ("vote", ["vote", "linked"], 3001)}
    assert max(rows_of_joins(df)) <= 2 * 3000
