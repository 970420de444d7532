"""Instruction examples under three limits: whole conversations, rows that can't be placed, and limits that bind."""

from collections import Counter, defaultdict

from tokenizers import Tokenizer

from heronry.llm import packing, registry
from heronry.llm.pretokens import tokenizer_path


def sizes(sf_dir, spark):
    tokenizer, out = Tokenizer.from_file(tokenizer_path()), defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        out[r.conv_id][0] += n
        out[r.conv_id][1] += n if r.role == "assistant" else 0
    return out


def test_conversations_are_packed_whole_under_each_limit(spark):
    sf_dir = "/root/testdata/sf0.01"
    want, limits = sizes(sf_dir, spark), packing.CONVERSATIONS
    rows = registry.QUERIES["packed_conversations"](spark, sf_dir).collect()
    assert Counter(r.example_id for r in rows) == Counter(want.keys())
    by_sequence = defaultdict(list)
    for r in rows:
        n, loss = want[r.example_id]
        assert r.status == ("empty" if n == 0 else "over-limit" if n > limits.tokens or loss > limits.loss_tokens else "packed")
        assert (r.sequence_id is None) == (r.status != "packed")
        if r.status == "packed":
            by_sequence[r.sequence_id].append(r)
    bound = Counter()
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += want[r.example_id][0]
        loss = sum(want[r.example_id][1] for r in members)
        assert at <= limits.tokens and len(members) <= limits.segments and loss <= limits.loss_tokens
        bound["segments"] += len(members) == limits.segments
        bound["loss"] += loss > 0.75 * limits.loss_tokens and at < 0.9 * limits.tokens
    assert bound["segments"] and bound["loss"]


def test_examples_that_cannot_be_placed_are_rows(spark):
    rows = [(1, 50, 10), (2, 101, 1), (3, 100, 61), (4, None, 3), (5, 0, 0), (6, 40, None), (None, 10, 5), (1, 50, 10)]
    examples = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long")
    told = Counter((r.example_id, r.status) for r in packing.pack_examples(examples, packing.Limits(100, 3, 60)).collect())
    assert told == Counter([(1, "packed"), (1, "packed"), (2, "over-limit"), (3, "over-limit"), (4, "empty"), (5, "empty"), (6, "packed"), (None, "packed")])
    assert packing.pack_examples(examples.limit(0), packing.Limits()).count() == 0


def test_vectors_fill_better_than_order_of_arrival(spark):
    """Long examples without loss beside short ones that bear it all: the product of demand and room puts them together."""
    rows = [(i, 90, 0) for i in range(60)] + [(100 + i, 10, 10) for i in range(60)]
    examples = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long").coalesce(1)
    used = packing.pack_examples(examples, packing.Limits(100, 8, 10)).select("sequence_id").distinct().count()
    assert used <= 63  # sixty are the least; in order of arrival 120 are needed
