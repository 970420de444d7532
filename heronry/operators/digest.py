"""The weekly digest: candidates, topics, cards, proposals, checked sentences and highlights, stage by stage.

Each stage is a table in shared storage under the run's folder; a run that is started again with the same folder reads the stages that
were finished and makes the others. What a model wrote (topics, sentences, highlights) is an input table. Everything is ordered by
scores with ids as ties, so equal inputs give equal digests.

Threads without a record by a person in the window are no candidates. Null titles count as empty; records without thread or time are left
out; repeated records (same id) count once; empty tables give an empty digest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions.text import is_machine, text
from heronry.sinks.release import _file

#: Days of the window and of the half-life, confidence of a topic and of routine, characters of a sentence, sentences of a card, and
#: highlights (fixed values).
WINDOW_DAYS, HALF_LIFE_DAYS = 7, 3.5
TOPIC_CONFIDENCE, ROUTINE_CONFIDENCE = 0.35, 0.6
LONGEST_SENTENCE, CARD_SENTENCES, HIGHLIGHTS = 240, 3, 3
OTHER = "other"
#: Words that claim a state, and what shows it: the status or the title of a cited thread; words that take a side (fixed values).
DONE_WORDS, DONE_STATUS = ["merged", "landed", "fixed"], ["merged", "resolved"]
RELEASE_WORDS, RELEASE_TITLE = ["released", "announced", "shipped"], r"(?i)\[announce\]"
RESULT_WORDS, RESULT_TITLE = ["verified", "passed", "approved", "accepted", "adopted"], r"(?i)\[(?:result|announce)\]"
SIDES = ["objected", "opposed", "rejected", "refused", "disagreed", "pushed back", "blocked"]


@dataclass(frozen=True)
class Rules:
    """What a project sets: authors who are machines, topics with the pattern of titles they take, and titles that are routine."""

    machines: tuple[str, ...] = ()
    topics: tuple[tuple[str, str], ...] = ()
    routine: str = "(?!)"


@dataclass
class Stages:
    """Tables of one run; `made` lists those that this run has made itself."""

    spark: SparkSession
    folder: str
    made: list[str] = field(default_factory=list)

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        files, mark = _file(self.spark, f"{path}/_SUCCESS")
        if not files.exists(mark):
            build().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)


def candidates(records: DataFrame, threads: DataFrame, end: Column, rules: Rules) -> DataFrame:
    """thread, title, status, kind, score, newest of threads with a person's record in the window.

    A record weighs half after HALF_LIFE_DAYS, and an author's k-th record in a thread a k-th.
    """
    inside = (F.col("at") >= end - F.make_dt_interval(F.lit(WINDOW_DAYS))) & (F.col("at") <= end)
    own = records.dropna(subset=["thread", "at"]).filter(inside & ~is_machine(F.col("author"), list(rules.machines))).dropDuplicates(["record"])
    nth = F.row_number().over(Window.partitionBy("thread", "author").orderBy("at", "record"))
    age = (F.unix_micros(end) - F.unix_micros("at")) / (86_400e6 * HALF_LIFE_DAYS)
    scored = own.select("thread", "at", (F.pow(F.lit(0.5), age) / nth).alias("weight")).groupBy("thread").agg(F.round(F.sum("weight"), 9).alias("score"), F.max("at").alias("newest"))
    return scored.join(threads, "thread").select("thread", text("title").alias("title"), "status", "kind", "score", "newest")


def ruled_topic(title: Column, rules: Rules) -> Column:
    """The first topic whose pattern a title has."""
    out = F.lit(OTHER)
    for topic, pattern in reversed(rules.topics):
        out = F.when(title.rlike(pattern), topic).otherwise(out)
    return out


def placed(chosen: DataFrame, classified: DataFrame, rules: Rules) -> DataFrame:
    """chosen with place (card, routine or uncategorized) and topic.

    classified: thread, topic, confidence, routine, routine_confidence. A thread that is not there, or whose entry lacks a field, goes by
    the rules of titles; so does the topic of one that the model was unsure of.
    """
    whole = classified.dropna().dropDuplicates(["thread"])
    told = chosen.join(whole, "thread", "left")
    known = F.col("topic").isNotNull()
    sure = known & (F.col("confidence") >= TOPIC_CONFIDENCE) & F.col("topic").isin([t for t, _ in rules.topics])
    topic = F.when(sure, F.col("topic")).otherwise(ruled_topic(F.col("title"), rules))
    routine = F.when(known, F.col("routine") & (F.col("routine_confidence") >= ROUTINE_CONFIDENCE)).otherwise(F.col("title").rlike(rules.routine))
    place = F.when(routine, "routine").when(topic == OTHER, "uncategorized").otherwise("card")
    return told.select(*chosen.columns, place.alias("place"), topic.alias("topic"))


def cards(threads: DataFrame) -> DataFrame:
    """topic, score (of its three best threads), rank and size."""
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "thread")
    best = threads.filter("place = 'card'").withColumn("nth", F.row_number().over(order))
    made = best.groupBy("topic").agg(F.round(F.sum(F.when(F.col("nth") <= 3, F.col("score"))), 9).alias("score"), F.count("*").alias("size"))
    return made.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "topic")))  # a row for each topic


def rejection(sentence: Column, cites: Column, inside: Column, statuses: Column, titles: Column) -> Column:
    """Why a sentence can't stand; null if it can. inside: all cites are threads that the model was given."""
    has = lambda word: F.lower(sentence).rlike(r"(?<![a-z0-9_])" + word.replace(" ", r"\s+") + r"(?![a-z0-9_])")
    shown = [(DONE_WORDS, F.exists(statuses, lambda s: s.isin(DONE_STATUS))), (RELEASE_WORDS, F.exists(titles, lambda t: t.rlike(RELEASE_TITLE))), (RESULT_WORDS, F.exists(titles, lambda t: t.rlike(RESULT_TITLE)))]
    reason = F.when((F.trim(sentence) == "") | (F.length(sentence) > LONGEST_SENTENCE), "length").when(F.size(cites) == 0, "no-cites").when(~inside, "cite-outside-inputs")
    for words, proof in shown:
        for word in words:
            reason = reason.when(has(word) & ~proof, f"status:{word}")
    for word in SIDES:
        reason = reason.when(has(word), f"stance:{word}")
    return reason


def checked(sentences: DataFrame, threads: DataFrame, given: DataFrame) -> DataFrame:
    """place, position, sentence, cites, reason (null: it stands).

    sentences: place, position, sentence, cites; given: place, thread (what the model had before it for each place). Cites are joined as
    rows, so a sentence with many cites is no large row of states.
    """
    key = ["place", "position"]
    rows = sentences.select(*key, text("sentence").alias("sentence"), F.coalesce("cites", F.expr("cast(array() AS array<string>)")).alias("cites"))
    cited = rows.select(*key, F.explode(F.array_distinct("cites")).alias("thread"))
    known = given.select("place", "thread").distinct().withColumn("given", F.lit(True))
    states = cited.join(known, ["place", "thread"], "left").join(threads.select("thread", "status", "title"), "thread", "left")
    gathered = states.groupBy(*key).agg(F.bool_and(F.coalesce("given", F.lit(False))).alias("inside"), F.collect_set("status").alias("statuses"), F.collect_set("title").alias("titles"))
    told = rows.join(gathered, key, "left")
    none = F.expr("cast(array() AS array<string>)")
    reason = rejection(F.col("sentence"), F.col("cites"), F.coalesce("inside", F.lit(True)), F.coalesce("statuses", none), F.coalesce("titles", none))
    return told.select(*key, "sentence", "cites", reason.alias("reason"))


def highlights(valid: DataFrame, threads: DataFrame, made: DataFrame, proposals: DataFrame) -> DataFrame:
    """rank, title, thread, fallback: the first valid highlights; where there is none, the newest thread of the first proposal, then the
    best thread of each card in turn that is not there yet, three in all.

    valid: position, sentence, cites; proposals: rank, thread. Picks come from one row for each proposal and three for each card.
    """
    order = Window.orderBy("position")
    shown = valid.orderBy("position").limit(HIGHLIGHTS).select(F.row_number().over(order).alias("rank"), F.col("sentence").alias("title"), F.get("cites", 0).alias("thread"), F.lit(False).alias("fallback"))
    newest = Window.partitionBy("rank").orderBy(F.desc("newest"), "thread")
    first = proposals.join(threads, "thread").withColumn("nth", F.row_number().over(newest)).filter("nth = 1").orderBy("rank").limit(1).select(F.lit(0).alias("turn"), F.lit(1).alias("nth"), "thread", "title")
    best = Window.partitionBy("topic").orderBy(F.desc("score"), "thread")
    # A thread stands in one card, so a card's best is the first pick's thread at most: its second best is all that may be needed.
    tops = threads.filter("place = 'card'").withColumn("nth", F.row_number().over(best)).filter("nth <= 2").join(made.select("topic", "rank"), "topic").select(F.col("rank").alias("turn"), "nth", "thread", "title")
    fresh = tops.join(first.select("thread"), "thread", "left_anti")
    one = fresh.withColumn("first", F.row_number().over(Window.partitionBy("turn").orderBy("nth"))).filter("first = 1").drop("first")
    picks = first.unionByName(one).orderBy("turn").limit(HIGHLIGHTS)
    fallback = picks.select(F.row_number().over(Window.orderBy("turn")).alias("rank"), "title", "thread", F.lit(True).alias("fallback"))
    return shown.unionByName(fallback.join(shown.agg(F.count("*").alias("n")), F.col("n") == 0).drop("n"))


SECTION = ["section", "rank", "key", "value"]


def digest(spark: SparkSession, folder: str, records: DataFrame, threads: DataFrame, classified: DataFrame, sentences: DataFrame, proposals: DataFrame, end: Column, rules: Rules) -> DataFrame:
    """section, rank, key, value: cards (topic, size), their threads, routine and uncategorized threads, sentences, rejections by reason,
    and highlights. sentences of place 'highlight' are the model's highlights; proposals: rank, thread."""
    stages = Stages(spark, folder)
    chosen = stages.table("candidates", lambda: candidates(records, threads, end, rules))
    mixed = stages.table("mixed", lambda: placed(chosen, classified, rules))
    made = stages.table("cards", lambda: cards(mixed))
    in_cards = mixed.filter("place = 'card'").select(F.col("topic").alias("place"), "thread")

    def stand(rows: DataFrame) -> DataFrame:
        return rows.filter("reason IS NULL").withColumn("nth", F.row_number().over(Window.partitionBy("place").orderBy("position"))).filter(F.col("nth") <= CARD_SENTENCES)

    told = stages.table("sentences", lambda: checked(sentences.filter("place <> 'highlight'"), mixed, in_cards))
    allowed = lambda: stand(told).select(F.lit("highlight").alias("place"), F.explode("cites").alias("thread"))
    heads = stages.table("heads", lambda: checked(sentences.filter("place = 'highlight'"), mixed, allowed()))
    shown = stages.table("highlights", lambda: highlights(heads.filter("reason IS NULL"), mixed, made, proposals))
    listed = lambda section: F.row_number().over(Window.partitionBy("place", "topic").orderBy(F.desc("score"), "thread")).alias("rank") if section == "card" else F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "thread")).alias("rank")
    parts = [
        made.select(F.lit("cards"), "rank", "topic", F.col("size").cast("string")),
        mixed.filter("place = 'card'").select(F.lit("threads"), listed("card"), "topic", "thread"),
        mixed.filter("place <> 'card'").select("place", listed("rest"), F.lit(""), "thread"),
        stand(told).select(F.lit("sentences"), F.col("nth"), "place", "sentence"),
        told.unionByName(heads).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("rejected"), F.lit(0), "reason", F.col("n").cast("string")),
        shown.select(F.lit("highlights"), "rank", F.when(F.col("fallback"), "fallback").otherwise("valid"), "title"),
    ]
    out = parts[0].toDF(*SECTION)
    for part in parts[1:]:
        out = out.union(part.toDF(*SECTION))
    return out


def rejected_and_recall(told: DataFrame, threads: DataFrame, important: DataFrame) -> DataFrame:
    """measure, key, value: rejections by reason, and the share of important threads (column thread) that a card holds."""
    reasons = told.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").cast("double").alias("value")).select(F.lit("rejected").alias("measure"), F.col("reason").alias("key"), "value")
    held = important.select("thread").distinct().join(threads.filter("place = 'card'").select("thread", F.lit(1).alias("held")), "thread", "left")
    return reasons.unionByName(held.agg(F.avg(F.coalesce("held", F.lit(0))).alias("value")).select(F.lit("recall").alias("measure"), F.lit("cards").alias("key"), "value"))
