"""Lexical and semantic search as one call: groups from both, fused ranks with kept leading matches, facets over both, and re-checked passages.

A ranking has a row for each group of one query, some hundreds; windows over a ranking are small. Passages come from a vector index that
may lag behind the release, so each is checked against the release that is read before it counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.operators import search as S


@dataclass(frozen=True)
class Fusion:
    """k of reciprocal ranks, passages kept for a group, and whether leading full matches keep their places (fixed values)."""

    k: float = 60.0
    passages: int = 3
    keep_leading: bool = True

    def __post_init__(self):
        if not self.k > 0 or self.passages < 1:
            raise ValueError("k and the number of passages must be positive")


def rechecked(candidates: DataFrame, release: DataFrame) -> DataFrame:
    """The candidates (chunk, fingerprint, score) whose chunk the release (chunk, fingerprint, group, project) holds with the same content, with group and project."""
    return candidates.join(release, ["chunk", "fingerprint"]).select("chunk", "group", "project", "score")


def semantic_groups(passages: DataFrame, most: int = 3) -> DataFrame:
    """group, project, semantic_rank, semantic_score, chunks (its best `most`): groups in the order of their best passages. A chunk counts once."""
    best = passages.groupBy("chunk", "group", "project").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "chunk"))
    kept = best.withColumn("nth", nth).filter(F.col("nth") <= most)
    rows = kept.groupBy("group", "project").agg(F.max("score").alias("semantic_score"), F.min(F.when(F.col("nth") == 1, F.col("chunk"))).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    order = Window.orderBy(F.desc("semantic_score"), "first")
    return rows.select("group", "project", F.row_number().over(order).alias("semantic_rank"), "semantic_score", "chunks")


def fused(lexical: DataFrame, semantic: DataFrame, config: Fusion = Fusion()) -> DataFrame:
    """group, project, lexical_rank, semantic_rank, score, rank.

    lexical: group, project, lexical_rank, exact, full (holds every word of the query). Exact matches come first, then the full matches
    that lead the lexical ranking without a gap, in its order, then falling reciprocal ranks; ties by lexical rank, then group.
    """
    gaps = F.sum(F.when(F.col("full"), 0).otherwise(1)).over(Window.orderBy("lexical_rank").rowsBetween(Window.unboundedPreceding, 0))
    left = lexical.withColumn("kept", (gaps == 0) if config.keep_leading else F.lit(False))
    both = left.join(semantic.withColumnRenamed("project", "other"), "group", "full_outer")
    clash = F.raise_error(F.concat(F.lit("a group stands in two projects: "), F.col("group").cast("string")))
    project = F.when(F.col("project") != F.col("other"), clash).otherwise(F.coalesce("project", "other"))
    share = lambda c: F.coalesce(1.0 / (config.k + F.col(c)), F.lit(0.0))
    rows = both.select("group", project.alias("project"), "lexical_rank", "semantic_rank", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("kept", F.lit(False)).alias("kept"), (share("lexical_rank") + share("semantic_rank")).alias("score"))
    order = Window.orderBy(F.desc("exact"), F.desc("kept"), F.when(F.col("kept"), F.col("lexical_rank")), F.desc("score"), F.asc_nulls_last("lexical_rank"), "group")
    return rows.select("group", "project", "lexical_rank", "semantic_rank", "score", F.row_number().over(order).alias("rank"))


def facets(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """project, groups: groups that matched words, and those that only passages found, before any limit."""
    groups = lexical.select("group", "project").unionByName(semantic.select("group", "project")).distinct()
    return groups.groupBy("project").agg(F.count("*").alias("groups"))


def hybrid(lexical: DataFrame, candidates: DataFrame | None, release: DataFrame, limit: int, projects: list[str] | None = None, config: Fusion = Fusion()) -> DataFrame:
    """The `limit` best groups of both rankings within the projects; where no vector index answers (None), the lexical order alone."""
    inside = F.col("project").isin(projects) if projects else F.lit(True)
    chosen = lexical.filter(inside)
    if candidates is None:
        return chosen.select("group", "project", "lexical_rank", F.lit(None).cast("int").alias("semantic_rank"), (1.0 / (config.k + F.col("lexical_rank"))).alias("score"), F.row_number().over(Window.orderBy("lexical_rank")).alias("rank")).filter(F.col("rank") <= limit)
    found = semantic_groups(rechecked(candidates, release).filter(inside), config.passages)
    return fused(chosen, found, config).filter(F.col("rank") <= limit)


def browse(entries: DataFrame, sort: str, query: str = "", project: str = "", status: str = "", tags: list[str] | None = None) -> DataFrame:
    """Feed entries (entry, project, status, tags, text, activity, newest) that pass the filters, with rank by hot (activity), recent or
    relevance (how many of the query's words the text holds); ties by time, then entry. Relevance without a query is hot."""
    words = query.lower().split()
    score = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    rows = entries.withColumn("score", score)
    for wanted, column in ((project, "project"), (status, "status")):
        rows = rows.filter(F.col(column) == wanted) if wanted else rows
    rows = rows.filter(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0) if tags else rows
    rows = rows.filter("score > 0") if words else rows
    first = {"recent": [], "relevance": [F.desc("score")] if words else [F.desc("activity")]}.get(sort, [F.desc("activity")])
    return rows.select("entry", "score", F.row_number().over(Window.orderBy(*first, F.desc("newest"), "entry")).alias("rank"))


def feed_chunks(entries: DataFrame, records: DataFrame, size: int = 180, overlap: int = 30) -> DataFrame:
    """group, record, ordinal, n_words, chunk: what a feed gives to the search, cut into windows of words.

    entries: group, records (ids); records: record, text. A record that no entry names, or an entry whose record is gone, gives nothing.
    """
    named = entries.select("group", F.explode("records").alias("record")).distinct()
    return S.chunks(records.select("record", "text"), "record", "text", size, overlap).join(named, "record").select("group", "record", "ordinal", "n_words", "chunk")


def detail_ref(revision: Column, group: Column, record: Column) -> Column:
    """An opaque reference to one record of a release."""
    return F.translate(F.rtrim(F.base64(F.to_json(F.struct(revision.alias("v"), group.alias("g"), record.alias("r"))).cast("binary")), F.lit("=")), "+/", "-_")


def hydrated(refs: DataFrame, details: DataFrame, revision: str) -> DataFrame:
    """ref, state, group, record, text of references (ref): found, stale (of another revision), unknown (no such record), or invalid."""
    padded = F.translate(F.col("ref"), "-_", "+/")
    padded = F.rpad(padded, F.length("ref") + (4 - F.length("ref") % 4) % 4, "=")
    read = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "v string, g long, r long")
    told = refs.select("ref", read.alias("x")).select("ref", F.col("x.v").alias("v"), F.col("x.g").alias("g"), F.col("x.r").alias("r"))
    there = details.select(F.col("group").alias("g"), F.col("record").alias("r"), "text", F.lit(True).alias("there"))
    both = told.join(there, ["g", "r"], "left")
    state = F.when(F.col("v").isNull(), "invalid").when(F.col("v") != revision, "stale").when(F.col("there").isNull(), "unknown").otherwise("found")
    fine = state == "found"
    return both.select("ref", state.alias("state"), F.when(fine, F.col("g")).alias("group"), F.when(fine, F.col("r")).alias("record"), F.when(fine, F.col("text")).alias("text"))
