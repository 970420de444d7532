"""Trie of conversation prefixes from one global sort: adjacent common prefixes, a stack sweep, and stitched partition boundaries.

A turn is known by a digest of role and text, a conversation by the digests of its turns in order, so conversations that share turns
from their first on stand next to each other once all are range-sorted by (digests, conv_id). A node (a sequence of turns) is then an
interval of rows, opened where the common prefix with the row before is shorter than it and closed where the one with the next is.

Each range is swept with a stack of its open nodes. All figures of a node are differences of running totals over the rows of its
interval, so they add up: a node that reaches over a range's edge leaves one partial row for each range it touches, and these are
summed by node. The edges (last row of the range before, first row of the next) come from one aggregate of a row for each range.
Copies of one conversation are told apart by conv_id in the sort, so they spread over ranges however many there are, and no task
gathers a node's members: its digest of members is fed in order as they pass, across ranges from blocks of bounded bytes.

Texts stay where they are read: what is shuffled are 24 characters of digest and a length for each turn. A conversation's digests and
its first turns' place beside its base conversation must fit in a task (some 40 bytes a turn).

Turns are ordered by turn (null first), then by digest, so ties have one order and repeated rows are turns each; null role or text
counts as empty; rows without conv_id belong to no conversation and are left out; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.llm.common import lean, small_batches, table
from heronry.scratch import persisted

#: Characters of a turn's digest (18 bytes in base 64), conversations to a base, and the most turns that are taken from it.
WIDTH, FAMILY, MOST_SHARED = 24, 100, 5
#: Characters of members in one partial row; rows of a batch.
BLOCK, ROWS = 1 << 18, 4096
#: Kinds of rows that a range is swept with: its edges come first.
BEFORE, AFTER, ROW = 0, 1, 2


def turn_digest(role: Column, text: Column) -> Column:
    """WIDTH characters that stand for (role, text); roles are kept apart from texts by their length."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.base64(F.unhex(F.substring(whole, 1, 36)))


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each a struct of digest d and code points n."""
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(F.col("role"), F.col("text")).alias("d"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    arrays = known.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "n"))).alias("turns"))  # nulls sort first
    return arrays.select("conv_id", F.transform("turns", lambda x: F.struct(x.d.alias("d"), x.n.alias("n"))).alias("turns"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """conv_id and turns: a conversation's first h turns are those of the base of its family, h from a checksum of its id."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    bases = arrays.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("first"))
    joined = arrays.withColumn("base", base).withColumn("h", h.cast("int")).join(bases, "base", "left")
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return joined.select("conv_id", F.concat(F.coalesce(F.expr("slice(first, 1, h)"), F.slice("turns", 1, 0)), own).alias("turns"))


def ranged(sequences: DataFrame) -> DataFrame:
    """part, key (joined digests), conv_id and sizes (code points of each turn), dealt into ranges of (key, conv_id)."""
    rows = sequences.select(F.array_join(F.col("turns.d"), "").alias("key"), "conv_id", F.col("turns.n").alias("sizes"))
    return rows.repartitionByRange("key", "conv_id").withColumn("part", F.spark_partition_id())


def edges(rows: DataFrame) -> DataFrame:
    """The last key before each range and the first one behind it, as rows of the range."""
    ends = rows.groupBy("part").agg(F.min(F.struct("key", "conv_id")).alias("low"), F.max(F.struct("key", "conv_id")).alias("high"))
    order = Window.orderBy("part")  # one row for each range
    both = ends.select("part", F.lag("high.key").over(order).alias("before"), F.lead("low.key").over(order).alias("after"))
    marks = both.select("part", F.explode(F.array(F.struct(F.lit(BEFORE).alias("kind"), F.col("before").alias("key")), F.struct(F.lit(AFTER).alias("kind"), F.col("after").alias("key")))).alias("m"))
    return marks.filter("m.key IS NOT NULL").select("part", "m.kind", "m.key", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<int>").alias("sizes"))


SWEPT = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent", pa.string()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64())]
    + [("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("node", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("members", pa.string())]
)
SWEPT_DDL = "conv_id long, depth long, parent_conv_id long, parent string, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node string, part int, block int, members string"


def shared_turns(x: str, y: str) -> int:
    """How many turns two keys have in common from the first on."""
    n = min(len(x), len(y))
    if x[:WIDTH] != y[:WIDTH] or not n:
        return 0
    if x[:n] == y[:n]:
        return n // WIDTH
    a, b = np.frombuffer(x[:n].encode(), np.uint8), np.frombuffer(y[:n].encode(), np.uint8)
    return int(np.argmax(a != b)) // WIDTH


class _Names:
    """A digest of each prefix of a key, made as far as it is asked for."""

    def __init__(self, key: str):
        self.key, self.state, self.made = key, hashlib.sha256(), []

    def __getitem__(self, depth: int) -> str:
        while len(self.made) <= depth:
            d = len(self.made)
            self.state.update(self.key[WIDTH * (d - 1) : WIDTH * d].encode() if d else b"")
            self.made.append(self.state.hexdigest())
        return self.made[depth]


class _Open:
    """A node on the stack and the running totals where it began; `above`: code points of the turns before its own; left, right: it reaches over that edge."""

    __slots__ = ("rows", "chars", "fresh", "leaves", "above", "left", "right", "inner", "least", "children", "members", "text", "size", "block", "waiting")

    def __init__(self, totals: tuple, above: int, left: bool, right: bool):
        self.rows, self.chars, self.fresh, self.leaves = totals
        self.above, self.left, self.right = above, left, right
        self.inner, self.least, self.children, self.members, self.text, self.size, self.block, self.waiting = False, None, 0, None, [], 0, 0, []


class Sweep:
    """One range, row by row: `out` takes a row for every node that ends and a partial row for every node that reaches over an edge."""

    def __init__(self, part: int, before: str | None, after: str | None, out):
        self.part, self.last, self.after, self.out = part, before, after, out
        self.names = {"left": _Names(before or ""), "right": _Names(after or "")}
        self.totals = [0, 0, 0, 0]  # rows, their code points, those of nodes opened, leaves closed
        self.stack: list[_Open] = []

    def _name(self, node: _Open, depth: int) -> str:
        return self.names["left" if node.left else "right"][depth]

    def _push(self, key: str, above: int, left: bool) -> None:
        depth, turn = len(self.stack), slice(WIDTH * (len(self.stack) - 1), WIDTH * len(self.stack))
        right = self.after is not None and (not depth or self.stack[-1].right and key[turn] == self.after[turn])
        self.stack.append(_Open(tuple(self.totals), above, left, right))

    def _partial(self, node: _Open, depth: int, n: int = 0, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        parent = self._name(self.stack[depth - 1], depth - 1) if depth else None
        self.out((node.least, depth, None, parent, n, children, leaves, saved, None, self._name(node, depth), self.part, node.block, ",".join(node.text)))
        node.block, node.text, node.size = node.block + 1, [], 0

    def _pop(self, ended: bool = True) -> None:
        """ended: no row of the node is left in any range, so whether it has children is known."""
        depth, node = len(self.stack) - 1, self.stack.pop()
        self.totals[3] += ended and not node.children and not node.inner
        n, chars, fresh, leaves = (now - then for now, then in zip(self.totals, (node.rows, node.chars, node.fresh, node.leaves), strict=True))
        saved = chars - n * node.above - fresh
        above = self.stack[-1] if depth else None
        if above and node.least is not None:
            above.least = node.least if above.least is None else min(above.least, node.least)
        if node.left or node.right:
            self._partial(node, depth, n, node.children, leaves, saved)
            return
        for child in node.waiting:
            self.out((*child[:2], node.least, *child[3:]))
        over = above is not None and (above.left or above.right)
        row = (node.least, depth, None, self._name(above, depth - 1) if over else None, n, node.children, leaves, saved, (node.members or hashlib.sha256()).hexdigest(), None, None, None, None)
        if above is None or over:
            self.out(row)
        else:
            above.waiting.append(row)

    def row(self, key: str, conv_id: int, sizes: list[int]) -> None:
        depth = len(key) // WIDTH
        common = shared_turns(self.last, key) if self.last is not None else -1
        if not self.stack:  # the range's first row: what it shares with the row before is open already
            above = 0
            for d in range(common + 1):
                self._push(key, above, True)
                self.stack[-1].inner = d < common
                above += sizes[d - 1] if d else 0
        while len(self.stack) - 1 > common:
            self._pop()
        above = sum(sizes[: len(self.stack) - 1]) if self.stack else 0
        for d in range(len(self.stack), depth + 1):
            if d:
                self.stack[-1].children += 1
            self._push(key, above, False)
            if d:
                above += sizes[d - 1]
                self.totals[2] += sizes[d - 1]
        self.last = key
        self.totals[0] += 1
        self.totals[1] += sum(sizes)
        node = self.stack[-1]
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.left or node.right:
            node.text.append(str(conv_id))
            node.size += len(node.text[-1]) + 1
            if node.size > BLOCK:
                self._partial(node, depth)
        elif node.members is None:
            node.members = hashlib.sha256(b"%d" % conv_id)
        else:
            node.members.update(b",%d" % conv_id)

    def end(self) -> None:
        kept = shared_turns(self.last, self.after) if self.after is not None else -1
        while self.stack:
            self._pop(len(self.stack) - 1 > kept)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def swept(rows: DataFrame) -> DataFrame:
    """A row for every node within one range (parent_conv_id, or the name of a parent that reaches over an edge), and partial rows (node, part, block)."""

    def run(batches):
        out, sweep, part, edge = [], None, None, {}
        for batch in batches:
            for at, kind, key, conv_id, sizes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != part:
                    if sweep:
                        sweep.end()
                    sweep, part, edge = None, at, {}
                if kind != ROW:
                    edge[kind] = key
                    continue
                if sweep is None:
                    sweep = Sweep(part, edge.get(BEFORE), edge.get(AFTER), out.append)
                sweep.row(key, conv_id, sizes)
                while len(out) >= ROWS:
                    yield _batch(out[:ROWS], SWEPT)
                    del out[:ROWS]
        if sweep:
            sweep.end()
        for k in range(0, len(out), ROWS):
            yield _batch(out[k : k + ROWS], SWEPT)

    marked = rows.select("part", F.lit(ROW).alias("kind"), "key", "conv_id", "sizes").union(edges(rows))
    return marked.repartition("part").sortWithinPartitions("part", "kind", "key", "conv_id").mapInArrow(lean(run), SWEPT_DDL)


def stitched(partials: DataFrame) -> DataFrame:
    """node, parent and the figures of every node that reaches over an edge, from its partial rows in the order of ranges."""
    schema = pa.schema([SWEPT.field(c) for c in STITCHED])

    def run(batches):
        out, name, total, members, begun = [], None, None, None, False

        def done():
            least, depth, parent, n, children, leaves, saved = total
            return (name, parent, least, depth, n, children, leaves, saved, members.hexdigest())

        for batch in batches:
            for node, parent, least, depth, n, children, leaves, saved, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if node != name:
                    if name is not None:
                        out.append(done())
                    name, total, members, begun = node, [least, depth, parent, 0, 0, 0, 0], hashlib.sha256(), False
                if least is not None:
                    total[0] = least if total[0] is None else min(total[0], least)
                for k, x in enumerate((n, children, leaves, saved)):
                    total[3 + k] += x
                if text:
                    members.update(("," if begun else "").encode() + text.encode())
                    begun = True
                if len(out) >= ROWS:
                    yield _batch(out, schema)
                    out = []
        if name is not None:
            out.append(done())
        if out:
            yield _batch(out, schema)

    ordered = partials.repartition("node").sortWithinPartitions("node", "part", "block")
    figures = ordered.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "members")
    return figures.mapInArrow(lean(run), "node string, parent string, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


STITCHED = ["node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of all prefixes of `sequences` (conv_id and turns: digests d and code points n), each once."""
    small_batches(sequences.sparkSession)
    found = persisted(swept(persisted(ranged(sequences), "trie-rows")), "trie-nodes")
    over = persisted(stitched(found.filter("node IS NOT NULL")), "trie-edges")
    names = over.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    within = found.filter("node IS NULL")
    under = within.filter("parent IS NOT NULL").drop("parent_conv_id").join(names, "parent").withColumnRenamed("of_parent", "parent_conv_id")
    edge = over.join(names, "parent", "left").withColumnRenamed("of_parent", "parent_conv_id")
    return within.filter("parent IS NULL").select(NODE).union(under.select(NODE)).union(edge.select(NODE))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the rebuilt conversations."""
    return trie(rebuilt(turn_arrays(table(spark, sf_dir, "conversations"))))


#: CRC-32 bit by bit: each byte joins at the first of its eight steps.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for x in string_split(conv_id::VARCHAR, '')])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"

OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor({_CRC}, 4294967295) % 6 AS h FROM t),
s AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM s),
q AS (SELECT conv_id, depth, list_slice(turns, 1, depth) AS prefix, len(turns) = depth AS ends FROM p),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN depth > 0 THEN length(prefix[depth].text) ELSE 0 END AS saved
  FROM q GROUP BY prefix, depth),
c AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (prefix)),
u AS (
  SELECT list_slice(prefix, 1, k) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT m.*, unnest(range(0, depth + 1)) AS k FROM m) GROUP BY 1)
SELECT m.conv_id::BIGINT AS conv_id, m.depth::BIGINT AS depth, o.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (prefix) LEFT JOIN m o ON m.depth > 0 AND o.prefix = list_slice(m.prefix, 1, m.depth - 1)
"""
