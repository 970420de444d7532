"""A search index at rest: postings in shards by term, lengths and statistics, written once and read by the shards that a query needs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import lexical as L
from heronry.operators import search as S
from heronry.scratch import persisted

SHARDS = 64


def shard_of(term: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def write_index(docs: DataFrame, key: str, tokens: Column, path: str, shards: int = SHARDS) -> None:
    """postings (partitioned by shard, sorted by term) and statistics (one row: n, mean_length) of the documents that hold a token.

    A document's postings are made in its own row (its tokens sorted and counted), so one shuffle by shard is all there is.
    """
    spark = docs.sparkSession
    split = docs.select(F.col(key).alias("key"), F.explode(F.array(tokens)).alias("t")).filter(F.size("t") > 0)
    terms = split.select("key", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("key", "length", "term").agg(F.count("*").cast("int").alias("tf"))
    df = terms.withColumn("shard", shard_of(F.col("term"), shards))
    df.repartition(shards, "shard", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{path}/postings")
    split.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean_length")).withColumn("shards", F.lit(shards)).withColumn("key_type", F.lit(docs.schema[key].dataType.simpleString())).write.parquet(f"{path}/statistics")
    counts = read_postings(spark, path).groupBy("shard", "term").agg(F.count("*").alias("df"))
    counts.repartition(1, "shard").sortWithinPartitions("term").write.partitionBy("shard").parquet(f"{path}/terms")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """key, length, term, tf, shard of the whole index; none where no document holds a token."""
    key = spark.read.parquet(f"{path}/statistics").first().key_type
    return spark.read.schema(f"key {key}, length int, term string, tf int, shard int").parquet(f"{path}/postings")


def read_terms(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Postings of the terms with their df: only the shards and row groups that may hold them are read."""
    statistics = spark.read.parquet(f"{path}/statistics").first()
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string").select("term", shard_of(F.col("term"), statistics.shards).alias("shard")).collect()
    wanted = F.col("shard").isin([r.shard for r in rows]) & F.col("term").isin([r.term for r in rows])
    postings = read_postings(spark, path).filter(wanted)
    df = spark.read.schema("term string, df long, shard int").parquet(f"{path}/terms").filter(wanted)
    return postings.join(F.broadcast(df.select("term", "df")), "term").select("key", "length", "term", "tf", "df", F.lit(statistics.n).alias("n"), F.lit(statistics.mean_length).alias("mean_length"))


def term_score() -> Column:
    return S.idf(F.col("n"), F.col("df")) * F.col("tf") * (S.K1 + 1) / (F.col("tf") + S.K1 * (1 - S.B + S.B * F.col("length") / F.col("mean_length")))


def scored(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """key, score of every document that holds a term: postings of the terms and stored statistics are all that is read.

    Scores are rounded to nine decimals, so that equal texts tie whatever order their terms are summed in."""
    return read_terms(spark, path, terms).groupBy("key").agg(F.round(F.sum(term_score()), 9).alias("score"))


def search_index(spark: SparkSession, path: str, terms: list[str], k: int) -> DataFrame:
    """key, score of the k best documents, ties by key."""
    return scored(spark, path, terms).orderBy(F.desc("score"), "key").limit(k)


def search_shards(spark: SparkSession, path: str, terms: list[str], k: int, parts: int = 8) -> DataFrame:
    """The same in two phases: the k best of each part of the documents by global statistics, in one pass, then of all."""
    ranked = scored(spark, path, terms).withColumn("part", F.pmod("key", F.lit(parts)))
    order = Window.partitionBy("part").orderBy(F.desc("score"), "key")
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("key", "score").orderBy(F.desc("score"), "key").limit(k)


EXACT_BOOST = 1000.0
TITLE, TAGS = 4, 2


def ranked_records(records: DataFrame, query: str, filters: S.Filters | None = None, tokens=L.terms, words=L.reading_words) -> DataFrame:
    """record, score, exact of the records that match: BM25 over weighted fields, a boost for exact queries, a bonus for phrases.

    records: record, title, body, tags, author, and what the filters name. Statistics are those of all records; filters choose among
    the scored ones. The bonus of a pair of adjacent query words is their mean idf, times the title's weight where the title holds
    the pair, once where the body does.
    """
    spark = records.sparkSession
    asked = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t"), L.word_pairs(words(F.lit(query))).alias("p")).first()
    if not asked.t:
        return records.limit(0).select("record", F.lit(0.0).alias("score"), F.lit(False).alias("exact"))
    weights = {"title": TITLE, "body": 1, "tags": TAGS, "author": 1}
    fields = F.struct(*[(F.flatten(F.transform("tags", lambda t: tokens(t))) if f == "tags" else tokens(F.col(f))).alias(f) for f in weights])
    held = records.select("*", F.explode(F.array(fields)).alias("own"))
    total = lambda of: reduce(Column.__add__, [F.lit(w) * of(F.col(f"own.{f}")) for f, w in weights.items()])
    counts = [total(lambda c, t=t: F.size(F.filter(c, lambda x: x == t))).alias(f"tf{i}") for i, t in enumerate(asked.t)]
    counted = held.select(*records.columns, total(F.size).alias("length"), *counts)
    index = {t: i for i, t in enumerate(asked.t)}
    pairs = [(a, b) for a, b in (p.split(" ") for p in asked.p) if a in index and b in index]
    stands = lambda c, a, b: F.contains(F.concat(F.lit(" "), F.array_join(words(F.col(c)), " "), F.lit(" ")), F.lit(f" {a} {b} "))
    # Words in reading order are only made where both terms of a pair stand.
    bonus = [F.when((F.col(f"tf{index[a]}") > 0) & (F.col(f"tf{index[b]}") > 0), F.when(stands("title", a, b), float(TITLE)).when(stands("body", a, b), 1.0)).alias(f"pair{k}") for k, (a, b) in enumerate(pairs)]
    low = F.lit(query.strip().lower())
    exact = L.is_exact_query(F.lit(query)) & F.when(F.lit("-" in query), F.array_contains(tokens(F.col("title")), low)).otherwise(F.contains(F.lower("title"), low) | F.contains(F.lower("body"), low))
    wanted = filters.column() if filters else F.lit(True)
    tfs = [f"tf{i}" for i in range(len(asked.t))]
    rows = persisted(counted.select("record", "length", *tfs, *bonus, exact.alias("exact"), wanted.alias("wanted")), "ranked")  # texts are read once
    sums = rows.filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), *[F.count_if(F.col(t) > 0).alias(f"d{t}") for t in tfs]).first()
    idf = [float(math.log(1 + (sums.n - sums[f"d{t}"] + 0.5) / (sums[f"d{t}"] + 0.5))) for t in tfs]
    norm = S.K1 * (1 - S.B + S.B * F.col("length") / F.lit(sums.mean_length or 1.0))
    score = reduce(Column.__add__, [F.lit(w) * F.col(t) * (S.K1 + 1) / (F.col(t) + norm) for w, t in zip(idf, tfs, strict=True)])
    for k, (a, b) in enumerate(pairs):
        score = score + F.coalesce(F.col(f"pair{k}"), F.lit(0.0)) * (idf[index[a]] + idf[index[b]]) / 2
    found = rows.filter(F.expr(" OR ".join(f"{t} > 0" for t in tfs)) & F.col("wanted"))
    return found.select("record", (score + F.when(F.col("exact"), EXACT_BOOST).otherwise(0.0)).alias("score"), "exact")
