"""Identities of people over several sources: components of links, accepted only where they contradict nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.graph import connected_components


def identity_links(identities: DataFrame, declared: DataFrame, corroborated: DataFrame) -> DataFrame:
    """id, person, conflict of every identity (id, source).

    Declared links (a, b) always join. A component that corroborated links would make is accepted if no source stands in it twice but
    where declared links alone have joined it so; else its identities keep their declared persons and are marked.
    """
    base = identities.join(connected_components(declared.select("a", "b")), "id", "left").select("id", "source", F.coalesce("root", "id").alias("base"))
    lift = lambda end: base.select(F.col("id").alias(end), F.col("base").alias(f"base_{end}"))
    between = corroborated.join(lift("a"), "a").join(lift("b"), "b").select(F.col("base_a").alias("a"), F.col("base_b").alias("b"))
    merged = base.join(connected_components(between).withColumnRenamed("id", "base"), "base", "left").withColumn("person", F.coalesce("root", "base"))
    doubled = merged.groupBy("person", "source").agg(F.count_distinct("base").alias("n")).groupBy("person").agg((F.max("n") > 1).alias("conflict"))
    told = merged.join(doubled, "person")
    return told.select("id", F.when(F.col("conflict"), F.col("base")).otherwise(F.col("person")).alias("person"), "conflict")


def newest_facts(facts: DataFrame, key: str, fact: str, month: str) -> DataFrame:
    """key, and the fact of its newest month; ties by the greater fact."""
    return facts.groupBy(key).agg(F.max_by(fact, F.struct(month, fact)).alias(fact))


def states_of(events: DataFrame, key: str, at: str, kind: str, states: dict[str, str], first: str = "open") -> DataFrame:
    """key, state: what the last event (by at, event_id) of a kind in `states` has set; `first` where none has."""
    named = F.create_map(*[F.lit(x) for pair in states.items() for x in pair])[F.col(kind)]
    rows = events.withColumn("state", named)
    return rows.groupBy(key).agg(F.coalesce(F.max_by("state", F.when(F.col("state").isNotNull(), F.struct(at, "event_id"))), F.lit(first)).alias("state"))


def person_facts(authored: DataFrame, assigned: DataFrame, started: DataFrame, persons: DataFrame) -> DataFrame:
    """person, item, roles (sorted): all facts (id, item) of a person's identities (id, person) as one line per item."""
    all_facts = authored.withColumn("role", F.lit("author")).unionByName(assigned.withColumn("role", F.lit("assignee"))).unionByName(started.withColumn("role", F.lit("starter")))
    return all_facts.join(persons.select("id", "person"), "id").groupBy("person", "item").agg(F.array_sort(F.collect_set("role")).alias("roles"))
