"""Lexical and semantic search as DataFrames: chunks, postings, BM25, group scores, facets, fusion, evaluation.

Postings are a long table; document frequencies and lengths come from two-phase aggregates; a query's terms are a broadcast table of
a few rows (the query is an argument), so scoring shuffles only matching postings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.functions import text as T

K1, B = 1.2, 0.75
FURTHER = 0.25
RRF = 60.0


@dataclass(frozen=True)
class Filters:
    """Evidence filter: any of the projects and sources, all of the tags, strictly between the instants."""

    projects: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None

    def __post_init__(self):
        for values in (self.projects, self.sources, self.tags):
            if len(set(values)) != len(values) or "" in values:
                raise ValueError("filter values must be unique and not empty")
        if self.after and self.before and self.after >= self.before:
            raise ValueError("after must lie before before")

    def column(self) -> Column:
        out = F.lit(True)
        if self.projects:
            out = out & F.col("project").isin(*self.projects)
        if self.sources:
            out = out & F.col("source").isin(*self.sources)
        if self.tags:
            out = out & (F.size(F.array_except(F.array(*map(F.lit, self.tags)), F.col("tags"))) == 0)
        if self.after:
            out = out & (F.col("at") > F.lit(self.after).cast("timestamp"))
        if self.before:
            out = out & (F.col("at") < F.lit(self.before).cast("timestamp"))
        return out


def chunks(records: DataFrame, key: str, body: str = "text", size: int = 180, overlap: int = 30) -> DataFrame:
    """Windows of `size` words with `overlap` shared words: key, ordinal, n_words, chunk."""
    step = size - overlap
    words = records.select(key, F.explode(F.array(F.filter(F.split(F.trim(T.text(body)), r"\s+"), lambda w: w != ""))).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - F.lit(size)) / F.lit(step))).cast("int")
    cut = words.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    part = F.slice("w", F.col("ordinal") * step + 1, size)
    return cut.select(key, "ordinal", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk"))


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, tf, length: one row per document and term."""
    split = docs.select(key, F.explode(F.array(tokens)).alias("t"))
    return split.select(key, F.size("t").alias("length"), F.explode("t").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(index: DataFrame, key: str) -> DataFrame:
    """One row: number of documents with a token and their mean length."""
    return index.select(key, "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """key, score of every document that holds a term of the query."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    hits = index.join(F.broadcast(asked), "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    # one row each: a statistics row and at most as many df rows as the query has terms
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus_statistics(index, key)))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return scored.groupBy(key).agg(F.round(F.sum(part), 9).alias("score"))


def bm25_texts(docs: DataFrame, key: str, tokens: Column, terms: list[str]) -> DataFrame:
    """bm25() straight from texts, for a query without a stored index: each text's counts of the query's terms are made in its own row,
    so nothing but one row of statistics is aggregated and no token is shuffled. One row of docs is one document."""
    asked = list(dict.fromkeys(terms))
    count = lambda term: F.size(F.filter("t", lambda x: x == term))
    split = docs.select(key, F.explode(F.array(tokens)).alias("t")).filter(F.size("t") > 0)
    rows = split.select(key, F.size("t").alias("length"), *[count(t).alias(f"tf{i}") for i, t in enumerate(asked)])
    one = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))]).first()
    norm = K1 * (1 - B + B * F.col("length") / F.lit(one.mean_length or 1.0))
    parts = [idf(F.lit(one.n), F.lit(one[f"df{i}"])) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) for i in range(len(asked))]
    found = reduce(Column.__or__, [F.col(f"tf{i}") > 0 for i in range(len(asked))], F.lit(False))
    return rows.filter(found).select(key, F.round(reduce(Column.__add__, parts, F.lit(0.0)), 9).alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def group_scores(scored: DataFrame, group: str, key: str, geometric: bool = True) -> DataFrame:
    """Group score: sum of score * 0.25^rank, or best + 0.25 * the others."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc(key))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    value = F.sum(F.col("score") * F.pow(F.lit(FURTHER), F.col("rank") - 1)) if geometric else F.max("score") + FURTHER * (F.sum("score") - F.max("score"))
    return ranked.groupBy(group).agg(value.alias("score"), F.count("*").alias("matches"), F.min(F.when(F.col("rank") == 1, F.col(key))).alias("best"))


def facets(scored: DataFrame, project: str, group: str) -> DataFrame:
    """Matching groups per project, counted before any project filter or limit."""
    return scored.groupBy(project).agg(F.countDistinct(group).alias("groups"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where a norm is 0."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))


def projection(a: Column, b: Column) -> Column:
    """Product of two arrays over the norm of the first: cosine similarity but for the second's norm, so that rounding by it makes and
    breaks no ties; 0 where the norm is 0."""
    norm = F.sqrt(_dot(a, a))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))


def first_vector(vectors: DataFrame) -> list[float]:
    """The vector with the least id; a zero, which nothing is near, where there is none."""
    row = vectors.orderBy("vec_id").select("embedding").first()
    return [float(x) for x in row.embedding] if row else [0.0]


def nearest(vectors: DataFrame, query: list[float], k: int, namespace: str | None = None, measure: Callable[[Column, Column], Column] = cosine) -> DataFrame:
    """The k most similar vectors above 0 (per namespace where one is named), ties by id: vec_id, score (the measure of vector and query)."""
    scored = vectors.withColumn("score", measure(F.col("embedding"), F.array(*map(F.lit, query)))).filter("score > 0")
    if namespace is None:
        return scored.orderBy(F.desc("score"), "vec_id").limit(k)
    order = Window.partitionBy(namespace).orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(lexical: DataFrame, semantic: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) rankings; lexical rank breaks ties, ranks absent on one side come last."""
    a, b = lexical.select(key, F.col("rank").alias("lexical_rank")), semantic.select(key, F.col("rank").alias("semantic_rank"))
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    both = a.join(b, key, "full_outer").withColumn("score", share("lexical_rank") + share("semantic_rank"))
    return both.orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc(key))


def protect_head(fused: DataFrame, query: str, key: str, head: int = 3, margin: float = 0.1) -> DataFrame:
    """Order repair: the leading lexical results stand before every result without a standing of its own, per query.

    A result stands out when its similarity exceeds the query's background (the 20th best) by `margin`. Rankings hold some
    hundred rows per query, so a window per query is small.
    """
    by_score = Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc(key))
    similar = Window.partitionBy(query).orderBy(F.desc_nulls_last("similarity"), F.asc(key))
    rows = fused.withColumn("position", F.row_number().over(by_score)).withColumn("s", F.row_number().over(similar))
    background = F.max(F.when(F.col("s") == F.least(F.lit(20), F.count("*").over(Window.partitionBy(query))), F.col("similarity"))).over(Window.partitionBy(query))
    protected = F.col("lexical_rank") <= head
    stands = F.coalesce(F.col("similarity") >= background + margin, F.lit(False))
    order = Window.partitionBy(query).orderBy(F.when(protected | stands, F.lit(0)).otherwise(F.lit(1)), "position")
    return rows.withColumn("final", F.row_number().over(order)).drop("s")


def evaluation(rankings: DataFrame, judgments: DataFrame, query: str, key: str, k: int = 10, depth: int = 20) -> DataFrame:
    """Recall, reciprocal rank (depth `depth`) and nDCG@k per query from (query, key, rank) and (query, key, grade)."""
    joined = rankings.join(judgments, [query, key], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    got = joined.groupBy(query).agg(
        F.sum(F.when((F.col("grade") > 0) & (F.col("rank") <= depth), 1).otherwise(0)).alias("found"),
        F.coalesce(F.max(F.when((F.col("grade") > 0) & (F.col("rank") <= depth), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("dcg"),
    )
    best = judgments.filter("grade > 0").withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), key)))
    ideal = best.groupBy(query).agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("ideal"))
    rows = got.join(ideal, query, "left")
    return rows.select(query, F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")).alias("recall"), "mrr", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))
