"""Captured pages of mailing lists and issue trackers as DataFrames, and the windows that the next poll reads.

Captures are JSON files that a fetcher left in shared storage; Spark reads them with a fixed schema, so a column that a page lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions import text as T

MAIL = "hits long, emails array<struct<mid string, epoch long, subject string, `from` string, body string>>"
ISSUES = "total long, issues array<struct<key string, fields struct<summary string, updated string, created string, reporter struct<displayName string>, comment struct<comments array<struct<id string, author struct<displayName string>, body string, created string>>>>>>"
MOST_DAYS = 30


def mail_events(spark: SparkSession, path: str, since: Column) -> DataFrame:
    """One row per mail of the captured pages: id, at, subject, author, body, state ('event', 'filtered' or 'outside').

    A page whose `hits` differs from its mails is an error: it is read whole or not at all.
    """
    pages = spark.read.schema(MAIL).json(path, multiLine=True)
    whole = F.when(F.col("hits") != F.size("emails"), F.raise_error(F.lit("page is incomplete"))).otherwise(F.col("emails"))
    mails = pages.select(F.explode(whole).alias("m")).select("m.*").dropDuplicates(["mid"])
    at = F.timestamp_seconds("epoch")
    state = F.when(T.is_notification_subject("subject"), "filtered").when(at < since, "outside").otherwise("event")
    return mails.select(F.col("mid").alias("id"), at.alias("at"), "subject", T.mail_author(F.col("from")).alias("author"), "body", state.alias("state"))


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Captured search pages as rows: key, reporter, summary and an array of comments (id, author, body)."""
    rows = spark.read.schema(ISSUES).json(path, multiLine=True).select(F.explode("issues").alias("i"))
    comments = F.transform("i.fields.comment.comments", lambda c: F.struct(c["id"].alias("id"), c["author"]["displayName"].alias("author"), c["body"].alias("body")))
    return rows.select("i.key", F.col("i.fields.reporter.displayName").alias("reporter"), F.col("i.fields.summary").alias("summary"), comments.alias("comments"))


def issue_events(issues: DataFrame) -> DataFrame:
    """One event per issue and one per comment: key, kind, id, author, body. Null or empty comments give the issue alone."""
    own = F.struct(F.lit("issue").alias("kind"), F.concat(F.lit("issue-"), F.col("key")).alias("id"), F.col("reporter").alias("author"), F.col("summary").alias("body"))
    told = F.transform("comments", lambda c: F.struct(F.lit("comment").alias("kind"), F.concat(F.lit("comment-"), F.col("key"), F.lit("-"), c["id"]).alias("id"), c["author"].alias("author"), c["body"].alias("body")))
    both = F.concat(F.array(own), F.coalesce(told, F.array().cast("array<struct<kind string, id string, author string, body string>>")))
    return issues.select("key", F.explode(both).alias("e")).select("key", "e.*")


def poll_windows(cursors: DataFrame, key: str, cursor: str, now: Column) -> DataFrame:
    """What the next poll reads per source: whole days of mail (2 to 30) and minutes of issues (to 30 days), and whether the gap was cut."""
    gap = (F.unix_micros(now) - F.unix_micros(cursor)).cast("double")
    days = F.least(F.lit(MOST_DAYS).cast("long"), F.greatest(F.lit(2).cast("long"), F.ceil(gap / 86_400e6) + 1))
    minutes = F.least(F.lit(MOST_DAYS * 1440).cast("long"), F.ceil(gap / 60e6))
    return cursors.select(key, days.alias("mail_days"), minutes.alias("jira_minutes"), (gap > MOST_DAYS * 86_400e6).alias("gap_capped"))
