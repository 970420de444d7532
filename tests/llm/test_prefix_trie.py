"""The conversation trie against its SQL twin and brute force, with ranges small enough that nodes reach over many edges."""

import hashlib
import random
import zlib

import pytest

from heronry.llm import prefix_trie, registry
from tests.oracle import connect, difference

SCHEMA = "conv_id long, turn long, role string, text string, key string, part string, d string, parent string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def by_force(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def subtree(p):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [subtree(c) for c in children.get(p, [])]
        return sum(b[0] for b in below) + (not below), own + sum(b[1] for b in below)

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), *subtree(p), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    rows = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(df))).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


def test_query_matches_its_sql(spark, sf_dir):
    assert difference(registry.QUERIES["op11_prefix_trie"](spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL["op11_prefix_trie"]) is None


@pytest.mark.parametrize(("seed", "parts", "block"), [(1, 4, 1 << 18), (2, 23, 12), (3, 60, 1)])
def test_nodes_across_ranges(spark, monkeypatch, seed, parts, block):
    """Random talks of few turns, so most nodes are shared; copies of one talk spread over many ranges."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(900), 150):
        talk = [rng.choice("abé日") * rng.randint(1, 3) for _ in range(rng.randint(0, 7))] if c % 3 else ["same", "talk", "for", "many", "of", "all"]
        rows += [(c, t, rng.choice(["user", "user", None]) if c % 3 else "user", text) for t, text in enumerate(talk)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(frame(spark, rows)) == by_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, None, None, None), (5, 2, "user", None), (5, 2, "user", "tie"), (7, 1, "a", "b"), (8, 1, "", "ab"), (100, 0, "user", "base"), (101, 0, "user", "own"), (101, 1, "user", "long " * 20_000)]
    rows += [(9, t, "user", "same") for t in range(300)] + [(10, t, "user", "same") for t in range(301)]
    assert found(frame(spark, rows)) == by_force(rows)
    assert found(frame(spark, rows).limit(0)) == []
    assert found(frame(spark, rows[:1])) == []


def test_ids_below_zero_and_turnless_conversations(spark):
    rows = [(c, 0, "user", "hello") for c in (-3, 1, 2, 4, 11)] + [(3, 0, "user", "hello"), (3, 1, "user", "more")]
    nodes = found(frame(spark, rows))
    assert sum(n[3] for n in nodes if n[1] == 0) == 6 and nodes[0][0] == -3
