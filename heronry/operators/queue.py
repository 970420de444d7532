"""The review queue: what waits for a reviewer, its order and counts, proposals with the pull requests behind their issues, and people.

Every operator takes the instant it is asked for. Pulls without reviews, and people without activity, are rows with zero or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions.text import is_machine

#: Days that a pull may wait before it is overdue (fixed value).
WAIT_DAYS = 7


def classified(pulls: DataFrame, reviews: DataFrame, now: Column, days: int = WAIT_DAYS, machines: tuple[str, ...] = ()) -> DataFrame:
    """number, reviewers, waiting_since, wait_days, bucket, reason of open pulls.

    pulls: number, author, draft, decision, created_at, updated_at (by the author, may be null); reviews: number, reviewer, at. Buckets are
    approved, noReviewer and waiting; a pull that is in none has a reason: draft, machine-author, recent-no-reviewer, author-turn, or
    recent-review-wait. An author's own reviews and those of machines count for nothing.
    """
    own = reviews.join(pulls.select("number", "author"), "number").filter((F.col("reviewer") != F.col("author")) & ~is_machine(F.col("reviewer"), list(machines)))
    told = own.groupBy("number").agg(F.count_distinct("reviewer").alias("reviewers"), F.max("at").alias("last_review"))
    rows = pulls.join(told, "number", "left").withColumn("reviewers", F.coalesce("reviewers", F.lit(0)))
    author_at = F.greatest("created_at", "updated_at")
    since = F.greatest(author_at, "last_review")
    wait = F.unix_micros(now) - F.unix_micros(since)
    overdue = wait > days * 86_400_000_000
    open_ = ~F.col("draft") & ~is_machine(F.col("author"), list(machines))
    approved = F.coalesce(F.col("decision") == "APPROVED", F.lit(False))
    authors_turn = F.coalesce(F.col("last_review") >= author_at, F.lit(False))
    bucket = F.when(open_ & approved, "approved").when(open_ & (F.col("reviewers") == 0) & overdue, "noReviewer").when(open_ & (F.col("reviewers") > 0) & ~authors_turn & overdue, "waiting")
    reason = F.when(F.col("draft"), "draft").when(~open_, "machine-author").when(approved, None).when(F.col("reviewers") == 0, F.when(~overdue, "recent-no-reviewer")).when(authors_turn, "author-turn").when(~overdue, "recent-review-wait")
    return rows.select("number", "reviewers", since.alias("waiting_since"), F.floor(wait / 86_400_000_000).alias("wait_days"), bucket.alias("bucket"), reason.alias("reason"))


def queue(told: DataFrame) -> DataFrame:
    """bucket, place, number, wait_days: the longest wait in whole days first, then the lower number."""
    order = Window.partitionBy("bucket").orderBy(F.desc("wait_days"), "number")
    return told.filter("bucket IS NOT NULL").select("bucket", F.row_number().over(order).alias("place"), "number", "wait_days")


def queue_counts(told: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: pulls by bucket and in all, queued votes and discussions (proposals: stage, queued) and in all, and what was unavailable."""
    pulls = told.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("noReviewer", "waiting", "approved")], F.count("bucket").alias("prs"))
    queued = lambda s: F.count_if(F.col("queued") & (F.col("stage") == s))
    kips = proposals.agg(queued("vote").alias("vote"), queued("discuss").alias("discuss"), F.count_if("queued").alias("kips"), F.count_if(F.col("queued").isNull()).alias("unavailable"))
    return pulls.crossJoin(F.broadcast(kips))  # a row on each side


def counts_differ(actual: DataFrame, stored: DataFrame) -> bool:
    """Whether stored counts are not those of the queue: such a queue is not published."""
    return sorted(actual.columns) != sorted(stored.columns) or actual.first().asDict() != stored.select(actual.columns).first().asDict()


def _proposals(threads: DataFrame, stages: list[str], cites: Column) -> DataFrame:
    """key, stage, stages, cites (an aggregate of its threads), newest of proposals that have a stage.

    threads: thread, newest, keys (proposals that the title names), issues (issue keys), tags (stages that its subject tags), is_pull. A
    pull that names a proposal gives the stage code; a thread that is no pull and names an issue that pulls name too gives linked and
    cites those pulls, once however many threads name the issue. `stage` is the first in the given order.
    """
    bits = lambda tags: sum((F.when(F.array_contains(tags, s), 1 << k).otherwise(0) for k, s in enumerate(stages)), F.lit(0)).alias("bits")
    named = threads.select("thread", "newest", "is_pull", "issues", "tags", F.explode(F.array_distinct("keys")).alias("key"))
    own = named.select("key", "thread", "newest", bits(F.concat("tags", F.when(F.col("is_pull"), F.array(F.lit("code"))).otherwise(F.expr("cast(array() AS array<string>)")))))
    pulls = threads.filter("is_pull").select("thread", "newest", F.explode(F.array_distinct("issues")).alias("issue"))
    asked = named.filter("NOT is_pull").select("key", F.explode(F.array_distinct("issues")).alias("issue")).distinct()
    linked = asked.join(pulls, "issue").select("key", "thread", "newest", bits(F.array(F.lit("linked"))))
    cited = own.unionByName(linked).groupBy("key", "thread").agg(F.max("newest").alias("newest"), F.bit_or("bits").alias("bits"))
    rows = cited.groupBy("key").agg(F.bit_or("bits").alias("bits"), cites.alias("cites"), F.max("newest").alias("newest"))
    held = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) > 0, s) for k, s in enumerate(stages)]), lambda s: s.isNotNull())
    return rows.select("key", F.get(held, 0).alias("stage"), held.alias("stages"), "cites", "newest").filter("stage IS NOT NULL")


def proposal_rows(threads: DataFrame, stages: list[str]) -> DataFrame:
    """key, stage, stages, cites (sorted threads), newest of proposals that have a stage."""
    return _proposals(threads, stages, F.array_sort(F.collect_set("thread")))


def proposal_counts(threads: DataFrame, stages: list[str]) -> DataFrame:
    """The same with the number of cited threads in place of their list, which grows with the table."""
    return _proposals(threads, stages, F.count("thread"))


def starter_links(starters: DataFrame, issues: DataFrame, least: int = 1) -> DataFrame:
    """mail, account, proposals of people who start a proposal's thread and stand on issues that name it, under the same name.

    starters: proposal, person (name key); issues: issue, proposal, account, name_key (reporter or assignee). A pair needs `least` proposals,
    and neither side may have another partner.
    """
    met = starters.join(issues.withColumnRenamed("name_key", "person"), ["proposal", "person"])
    pairs = met.groupBy(F.col("person").alias("mail"), "account").agg(F.count_distinct("proposal").alias("proposals"))
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return pairs.withColumn("only", alone("mail") & alone("account")).filter(F.col("only") & (F.col("proposals") >= least)).drop("only")


def precision(persons: DataFrame, committers: DataFrame) -> DataFrame:
    """verdict, n of identity components (person, source, name): agree where its code account and its names are one committer's, differ where
    they are several's, unknown where no committer is among them.

    committers: name, login. Names and accounts are looked up apart.
    """
    by_login = persons.filter("source = 'g'").join(committers.select(F.col("login").alias("name"), F.col("login").alias("who")), "name")
    by_name = persons.filter("source <> 'g'").join(committers.select("name", F.col("login").alias("who")), "name")
    found = by_login.select("person", "who").unionByName(by_name.select("person", "who")).groupBy("person").agg(F.count_distinct("who").alias("n"))
    told = persons.select("person").distinct().join(found, "person", "left")
    return told.groupBy(F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "agree").otherwise("differ").alias("verdict")).agg(F.count("*").alias("n"))


def people(reviews: DataFrame, now: Column, months: int = 12, machines: tuple[str, ...] = ()) -> DataFrame:
    """login, reviews, newest of everyone who reviewed within the months, machines left out; logins are told apart without case."""
    recent = reviews.filter((F.col("at") > F.add_months(now, -months).cast("timestamp")) & (F.col("at") <= now) & ~is_machine(F.col("reviewer"), list(machines)))
    return recent.groupBy(F.lower("reviewer").alias("login")).agg(F.count("*").alias("reviews"), F.max("at").alias("newest"))


def person_search(found: DataFrame, query: str, limit: int) -> DataFrame:
    """login, place of the people whose login holds the query: equal first, then beginning with it, then by login."""
    key = query.strip().lstrip("@").lower()
    held = found.filter(F.contains("login", F.lit(key)) & F.lit(key != ""))
    order = Window.orderBy(F.when(F.col("login") == key, 0).when(F.col("login").startswith(key), 1).otherwise(2), "login")
    return held.select("login", F.row_number().over(order).alias("place")).filter(F.col("place") <= limit)


def activity_view(activity: DataFrame, person: str) -> DataFrame:
    """thread, records, newest, areas, others of one person's threads: its own records and areas, and who else took part.

    activity: thread, person, at, area. The person's threads are found first, so only their rows are grouped.
    """
    own = activity.filter(F.col("person") == person).select("thread").distinct()
    rows = activity.join(own, "thread", "left_semi")
    mine = F.col("person") == person
    return rows.groupBy("thread").agg(F.count_if(mine).alias("records"), F.max(F.when(mine, F.col("at"))).alias("newest"), F.array_sort(F.collect_set(F.when(mine, F.col("area")))).alias("areas"), F.array_sort(F.collect_set(F.when(~mine, F.col("person")))).alias("others"))
