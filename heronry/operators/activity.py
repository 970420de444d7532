"""Activity of people in threads and projects: running windows, tallies, reviews, coverage, sets and joins, as operators over any columns.

Columns are named by the caller and instants are arguments. Orders end in a unique column that the caller names, so ties have one
outcome; null keys are groups of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- windows -----------------------------------------------------------------------------------------------------------------------


def numbered(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """rows with a running number within each group, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def first_appearance(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, place: distinct keys in the order in which they first appear. The numbering has a row for each key."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("first"))
    return firsts.select(key, F.row_number().over(Window.orderBy("first", key)).cast("long").alias("place"))


def cut_value(rows: DataFrame, group: str, value: str, tie: str, k: int) -> DataFrame:
    """group, cut: the k-th largest value of each group, or the least where it has fewer."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), tie))).filter(F.col("_n") <= k)
    return ranked.groupBy(group).agg(F.min(value).alias("cut"))


def gaps(rows: DataFrame, group: str, at: str, tie: str) -> DataFrame:
    """tie, gap_us: microseconds until the next row of the group; null for the last."""
    following = F.lead(at).over(Window.partitionBy(group).orderBy(at, tie))
    return rows.select(tie, (F.unix_micros(following) - F.unix_micros(at)).alias("gap_us"))


def leading(rows: DataFrame, group: str, order: str, stop: Column) -> DataFrame:
    """group, leading: how many rows come before the first that stops; all where none does."""
    first = rows.groupBy(group).agg(F.min(F.when(stop, F.col(order))).alias("_stop"))
    before = F.count_if(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    return rows.join(first, group).groupBy(group).agg(before.alias("leading"))


def slow_runs(runs: DataFrame, group: str, order: list, value: str, key: str, width: int = 5, least: int = 3, factor: float = 2.0) -> DataFrame:
    """key, n, mean_before, slow: each run against the mean of up to `width` runs before it; slow needs `least` of them."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(-width, -1)
    mean = F.avg(value).over(before)
    n = F.count("*").over(before)
    return runs.select(key, n.alias("n"), mean.alias("mean_before"), ((n >= least) & (F.col(value) > factor * mean)).alias("slow"))


def ends(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """group, first and last: a column's value in the first and the last row."""
    return rows.groupBy(group).agg(F.min_by(column, order).alias("first"), F.max_by(column, order).alias("last"))


# --- tallies -------------------------------------------------------------------------------------------------------------------------


def activity_score(events: DataFrame, key: str, at: str, number: str, since: Column, until: Column, counts: Column) -> DataFrame:
    """key, score and evidence (ids in order) of what counts between two instants."""
    inside = events.filter((F.col(at) >= since) & (F.col(at) <= until) & counts)
    return inside.groupBy(key).agg(F.count("*").alias("score"), F.array_sort(F.collect_list(number)).alias("evidence"))


def newest_lag(rows: DataFrame, key: str, at: str, as_of: Column, days: int) -> DataFrame:
    """key, newest, lagging: whether a source's newest row is older than so many days."""
    return rows.groupBy(key).agg(F.max(at).alias("newest")).withColumn("lagging", F.col("newest") < as_of - F.make_dt_interval(F.lit(days)))


def topic_mix(rows: DataFrame, text: str, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """topic, threads: rows by the first word that their text holds."""
    topic = F.lit(default)
    for name, word in reversed(rules):
        topic = F.when(F.contains(F.lower(text), F.lit(word)), name).otherwise(topic)
    return rows.groupBy(topic.alias("topic")).agg(F.count("*").alias("threads"))


def stage_counts(rows: DataFrame, stage: str, person: str, at: str) -> DataFrame:
    """stage, threads, people, newest."""
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("threads"), F.count_distinct(person).alias("people"), F.max(at).alias("newest"))


def verdict_memory(events: DataFrame, key: str, order: list, number: str, kind: str, dismissed: str) -> DataFrame:
    """key, number, verdict_before: of each key's last dismissal by number, what it had before it."""
    before = F.lag(kind).over(Window.partitionBy(key).orderBy(*order))
    rows = events.withColumn("_before", before).filter(F.col(kind) == dismissed)
    return rows.groupBy(key).agg(F.max(number).alias(number), F.max_by("_before", number).alias("verdict_before"))


def month_summary(events: DataFrame, key: str, at: str, kind: str, counted: dict[str, str], days_of: str) -> DataFrame:
    """key, month, a count for each kind in `counted`, days with a `days_of`, and the last day."""
    counts = [F.count_if(F.col(kind) == k).alias(name) for name, k in counted.items()]
    days = F.count_distinct(F.when(F.col(kind) == days_of, F.to_date(at))).alias(f"{days_of}_days")
    return events.groupBy(key, F.date_format(at, "yyyy-MM").alias("month")).agg(*counts, days, F.to_date(F.max(at)).alias("last_day"))


def given_received(reviews: DataFrame, giver: str, receiver: str, item: str, name: str) -> DataFrame:
    """name, given, received: distinct items that someone reviewed for others, and that others reviewed for them; one's own count for nothing."""
    pairs = reviews.filter(F.col(giver) != F.col(receiver)).select(giver, receiver, item).distinct()
    sides = pairs.select(F.col(giver).alias(name), F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(pairs.select(F.col(receiver).alias(name), F.lit(0).alias("g"), F.lit(1).alias("r")))
    return sides.groupBy(name).agg(F.sum("g").alias("given"), F.sum("r").alias("received"))


def coverage(groups: DataFrame, group: str, key: str, covered: DataFrame) -> DataFrame:
    """group, total, covered: distinct keys of each group, and those of them that are covered."""
    marks = covered.select(key).distinct().withColumn("_c", F.lit(True))
    rows = groups.select(group, key).distinct().join(marks, key, "left")
    return rows.groupBy(group).agg(F.count("*").alias("total"), F.count("_c").alias("covered"))


def starters(events: DataFrame, item: str, person: str, order: list) -> DataFrame:
    """item, starter, and the last of `order`: who came first to each item."""
    return events.groupBy(item).agg(F.min_by(F.struct(F.col(person).alias("starter"), order[-1]), F.struct(*order)).alias("f")).select(item, "f.*")


def vote_tally(votes: DataFrame, topic: str, voter: str, order: list, vote: str, binding: str, plus: str, minus: str, quorum: int = 3) -> DataFrame:
    """topic, plus_one, minus_one, binding, state: each voter's last vote counts. vetoed while a -1 isn't outvoted, passing with a quorum of binding votes."""
    last = votes.groupBy(topic, voter).agg(F.max_by(F.struct(vote, binding), F.struct(*order)).alias("v"))
    is_plus = F.col(f"v.{vote}") == plus
    sums = last.groupBy(topic).agg(F.count_if(is_plus).alias("plus_one"), F.count_if(F.col(f"v.{vote}") == minus).alias("minus_one"), F.count_if(is_plus & F.col(f"v.{binding}")).alias("binding"))
    state = F.when((F.col("minus_one") > 0) & (F.col("minus_one") >= F.col("plus_one")), "vetoed").when((F.col("binding") >= quorum) & (F.col("plus_one") > F.col("minus_one")), "passing").otherwise("open")
    return sums.withColumn("state", state)


def longest_waits(rows: DataFrame, group: str, key: str, days: Column, k: int) -> DataFrame:
    """group, key, days, total: the k longest waits of each group and how many wait in all; the count is made apart from the ranking."""
    waits = rows.select(group, key, days.alias("days"))
    ranked = waits.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("days"), key))).filter(F.col("_n") <= k).drop("_n")
    return ranked.join(waits.groupBy(group).agg(F.count("*").alias("total")), group)


def review_clock(threads: DataFrame, reviews: DataFrame, key: str, made: str, reviewer: str, at: str, days: int) -> DataFrame:
    """key, reviewers, last_review, clock: whose turn it is: waiting without a review, the author's after a late one, else the reviewer's."""
    told = reviews.groupBy(key).agg(F.count_distinct(reviewer).alias("reviewers"), F.max(at).alias("last"))
    rows = threads.groupBy(key).agg(F.max(made).alias("made")).join(told, key, "left")
    clock = F.when(F.col("last").isNull(), "waiting").when(F.col("last") > F.col("made") + F.make_dt_interval(F.lit(days)), "author").otherwise("reviewer")
    return rows.select(key, F.coalesce("reviewers", F.lit(0)).alias("reviewers"), F.to_date("last").alias("last_review"), clock.alias("clock"))


def count_line(n: Column, shown: int) -> Column:
    """A count of results as a line of text."""
    return F.concat(n.cast("string"), F.when(n == 1, " result").otherwise(" results"), F.when(n > shown, f", {shown} shown").otherwise(""))


def run_counts(rows: DataFrame, run: str, rejected: Column) -> DataFrame:
    """run, entries, rejected, status: complete, partial, or failed where every entry was rejected."""
    counts = rows.groupBy(run).agg(F.count("*").alias("entries"), F.count_if(rejected).alias("rejected"))
    return counts.withColumn("status", F.when(F.col("rejected") == 0, "complete").when(F.col("rejected") == F.col("entries"), "failed").otherwise("partial"))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """auc: how often a positive row scores above a negative one, ties half. Counts by score come first, so the running sum has a row for each score."""
    by_score = rows.groupBy(score).agg(F.sum(label).alias("pos"), (F.count("*") - F.sum(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by_score.withColumn("below", below).agg((F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))) / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


# --- joins and sets ------------------------------------------------------------------------------------------------------------------


def missing(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """rows whose column names no known key."""
    return rows.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def newer_wins(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row for each key: the incoming one where there is one."""
    rest = [c for c in stored.columns if c != key]
    both = stored.select(key, F.struct(*rest).alias("s")).join(incoming.select(key, F.struct(*rest).alias("i")), key, "full_outer")
    return both.select(key, F.coalesce("i", "s").alias("r")).select(key, "r.*")


def first_of_equal(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """key, first: the least key that has the same content; contents are told by digest, so no text is shuffled."""
    marked = rows.select(key, F.sha2(content.cast("binary"), 256).alias("_f"))
    return marked.join(marked.groupBy("_f").agg(F.min(key).alias("first")), "_f").select(key, "first")


def kept_first(rows: DataFrame, content: str, key: str, columns: list[str]) -> DataFrame:
    """key and columns of the first row of each content (null is a content)."""
    return rows.groupBy(F.sha2(F.coalesce(F.concat(F.lit("x"), content), F.lit("")).cast("binary"), 256)).agg(F.min_by(F.struct(key, *columns), key).alias("r")).select("r.*")


def same_keys(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """equal: whether two tables hold the same distinct keys; one join of distinct keys tells."""
    x, y = left.select(F.col(a).alias("k")).distinct().withColumn("x", F.lit(1)), right.select(F.col(b).alias("k")).distinct().withColumn("y", F.lit(1))
    return x.join(y, "k", "full_outer").agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("equal"))


def sparse_pairs(pairs: DataFrame, a: str, b: str, most_a: int, most_b: int) -> DataFrame:
    """Distinct pairs whose first side stands in at most `most_a` of them and whose second in at most `most_b`. Keys are counted first, so a hot key is one row."""
    rows = pairs.select(a, b).distinct()
    few = lambda c, most: rows.groupBy(c).agg(F.count("*").alias("_n")).filter(F.col("_n") <= most).select(c)
    return rows.join(few(a, most_a), a, "left_semi").join(few(b, most_b), b, "left_semi").select(a, b)


def later_of_two(first: DataFrame, second: DataFrame, key: str, at: str, names: tuple[str, str]) -> DataFrame:
    """key, stage: the name of the side whose newest row is later; the second on ties and where the first is absent."""
    x, y = first.groupBy(key).agg(F.max(at).alias("x")), second.groupBy(key).agg(F.max(at).alias("y"))
    both = x.join(y, key, "full_outer")
    return both.select(key, F.when(F.col("y").isNull() | (F.col("x") > F.col("y")), names[0]).otherwise(names[1]).alias("stage"))


def in_busy_groups(rows: DataFrame, group: str, counts: Column, least: int) -> DataFrame:
    """Rows of groups in which at least so many rows count."""
    busy = rows.groupBy(group).agg(F.count_if(counts).alias("_n")).filter(F.col("_n") >= least).select(group)
    return rows.join(busy, group, "left_semi")


def sequence_issues(rows: DataFrame, group: str, number: str) -> DataFrame:
    """group, repeated, gaps: whether numbers repeat, and whether they leave out any from 0 on."""
    return rows.groupBy(group).agg((F.count("*") != F.count_distinct(number)).alias("repeated"), ((F.min(number) != 0) | (F.max(number) != F.count("*") - 1)).alias("gaps"))


def work_with(rows: DataFrame, person: str, partner: str, item: str, k: int) -> DataFrame:
    """person, partner, n: the k partners with whom someone shares most distinct items."""
    shared = rows.select(person, partner, item).distinct().groupBy(person, partner).agg(F.count("*").alias("n"))
    order = Window.partitionBy(person).orderBy(F.desc("n"), partner)
    return shared.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def with_other(rows: DataFrame, group: str, k: int, name: str) -> DataFrame:
    """name, n: the k largest groups, and all others as one. The ranking has a row for each group."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), group)))
    return counts.groupBy(F.when(F.col("_r") <= k, F.col(group)).otherwise("other").alias(name)).agg(F.sum("n").alias("n"))


def missing_days(rows: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """day: days from first to last on which nothing happened."""
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return calendar.join(rows.select(F.to_date(at).alias("day")).distinct(), "day", "left_anti")


# --- health ----------------------------------------------------------------------------------------------------------------------------


def trend(rows: DataFrame, at: str, error: Column, days: int = 7, least: int = 3) -> DataFrame:
    """day, n, errors, status: each day against the mean of the days before it: drop below half, spike above one and a half. Days are counted first."""
    counts = rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"))
    before = Window.orderBy("day").rowsBetween(-days, -1)
    usual, history = F.avg("n").over(before), F.count("*").over(before)
    status = F.when(history < least, "no_history").when(F.col("n") < 0.5 * usual, "drop").when(F.col("n") > 1.5 * usual, "spike").otherwise("ok")
    return counts.select("day", "n", "errors", status.alias("status"))


def worst_status(rows: DataFrame, key: str, levels: list[tuple[Column, str]], default: str) -> DataFrame:
    """key, status: the first level, worst first, that any of its rows reaches."""
    status = F.lit(default)
    for test, name in reversed(levels):
        status = F.when(F.bool_or(F.coalesce(test, F.lit(False))), name).otherwise(status)
    return rows.groupBy(key).agg(status.alias("status"))


def diagnosis_plan(firings: DataFrame, at: str, subject: str, number: str, most: int) -> DataFrame:
    """day, subject, first_id, firings: each day's first `most` subjects in the order in which they fired."""
    told = firings.groupBy(F.to_date(at).alias("day"), subject).agg(F.min(number).alias("first_id"), F.count("*").alias("firings"))
    order = Window.partitionBy("day").orderBy("first_id")
    return told.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def volume_cap(rows: DataFrame, group: str, cap: int) -> DataFrame:
    """group, n, share, over_cap."""
    return rows.groupBy(group).agg(F.count("*").alias("n")).select(group, "n", F.round(F.col("n") / cap, 4).alias("share"), (F.col("n") > cap).alias("over_cap"))
