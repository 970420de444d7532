"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the rows it reads: no shuffle, a pool of bounded size, and sequence ids that hold the task's partition number,
so a task that runs again after a lost executor gives the same rows. The heuristic is dot-product: among the pooled pieces that
fit, the one whose demand vector has the largest product with the free capacity of the open sequence is placed. Where pieces may
be cut, the best piece that doesn't fit whole fills the gap; the last sequence of a task is cut into powers of two, which need
no padding.

Null text counts as empty and becomes one piece (the end token alone); null doc_id stays null; repeated rows are packed each;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import id_and_text, lean, small_batches, table
from heronry.llm.pretokens import frequent_chunks, tokenizer_path, worker_cache
from heronry.llm.token_counts import token_counts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 4096
    loss_tokens: int = 4096


@dataclass
class Piece:
    """Part of an example: `length` tokens from `start` on, of which those in `loss` (a 0/1 array, None: all) bear loss."""

    key: object
    start: int
    length: int
    total: int
    ids: np.ndarray | None = None
    loss: np.ndarray | None = None

    def loss_tokens(self, upto: int | None = None) -> int:
        n = self.length if upto is None else upto
        return n if self.loss is None else int(self.loss[:n].sum())

    def split(self, at: int) -> tuple[Piece, Piece]:
        cut = lambda x: (None, None) if x is None else (x[:at], x[at:])
        (a, b), (c, d) = cut(self.ids), cut(self.loss)
        return Piece(self.key, self.start, at, self.total, a, c), Piece(self.key, self.start + at, self.length - at, self.total, b, d)


class Packer:
    """Streams pieces into sequences: lists of pieces that stand gapless from offset 0.

    One sequence is open at a time, and stays open while pieces come in; the pool is what the next piece for it is chosen from. A
    sequence is closed when no token or segment is left or, where pieces may not be cut, when nothing in a full pool fits.
    """

    def __init__(self, limits: Limits, cut: bool = True, pool: int = 256):
        self.limits, self.cut, self.size, self.pool = limits, cut, pool, []
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.demand = np.zeros((pool + 1, 3))
        self.open, self.left = [], self.cap.copy()

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        if not self.cut and (piece.length > self.limits.tokens or piece.loss_tokens() > self.limits.loss_tokens):
            raise ValueError(f"an example of {piece.length} tokens, {piece.loss_tokens()} with loss, exceeds a limit and may not be cut")
        while piece.length > self.limits.tokens or piece.loss_tokens() > self.limits.loss_tokens:
            head, piece = piece.split(self._fitting(piece, self.limits.tokens, self.limits.loss_tokens))
            yield [head]
        self.demand[len(self.pool)] = piece.length, 1, piece.loss_tokens()
        self.pool.append(piece)
        while len(self.pool) > self.size:
            yield from self._place()

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield from self._place()
        if self.open and self.cut:
            yield from self._powers_of_two(self.open)
        elif self.open:
            yield self.open
        self.open, self.left = [], self.cap.copy()

    def _fitting(self, piece: Piece, tokens: int, loss: int) -> int:
        """The longest prefix within both limits; at least one token."""
        n = min(piece.length, tokens)
        if piece.loss is not None and piece.loss_tokens(n) > loss:
            n = int(np.searchsorted(np.cumsum(piece.loss[:n]), loss, side="right"))
        elif piece.loss is None:
            n = min(n, loss)
        return max(n, 1)

    def _place(self) -> Iterator[list[Piece]]:
        """Places the best piece of the pool, or the part of it that fits, or closes the open sequence."""
        demand = self.demand[: len(self.pool)]
        score = demand @ (self.left / self.cap**2)
        fits = (demand <= self.left).all(axis=1)
        if fits.any():
            best = int(np.argmax(np.where(fits, score, -1.0)))
            self.open.append(self.pool[best])
            self.left -= demand[best]
            last = self.pool.pop()
            if best < len(self.pool):
                self.pool[best], demand[best] = last, demand[len(self.pool)]
            if self.left[0] >= 1 and self.left[1] >= 1:
                return
        elif self.cut and self.left[2] >= 1:
            best = int(np.argmax(score))
            head, rest = self.pool[best].split(self._fitting(self.pool[best], int(self.left[0]), int(self.left[2])))
            self.pool[best], demand[best] = rest, (rest.length, 1, rest.loss_tokens())
            self.open.append(head)
        yield self.open
        self.open, self.left = [], self.cap.copy()

    @staticmethod
    def _powers_of_two(sequence: list[Piece]) -> Iterator[list[Piece]]:
        total, rest = sum(p.length for p in sequence), list(sequence)
        while total:
            room, part = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                piece = rest.pop(0)
                if piece.length > room:
                    piece, back = piece.split(room)
                    rest.insert(0, back)
                part.append(piece)
                room -= piece.length
            yield part


def pack_pieces(pieces: Iterable[Piece], limits: Limits, cut: bool = True) -> Iterator[list[Piece]]:
    packer = Packer(limits, cut)
    for piece in pieces:
        yield from packer.add(piece)
    yield from packer.finish()


def pack_texts(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 2) -> DataFrame:
    """Pieces of all texts, each text's ids followed by `end_id`; every token bears loss and texts may be cut anywhere."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    frequent = frequent_chunks(docs, path)
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches, cache) -> Iterator[Piece]:
        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.frombuffer(cache.ids(text.as_py()) + end, "<u4")
                yield Piece(key.as_py(), 0, len(ids), len(ids), ids)

    def pack(batches):
        from pyspark import TaskContext

        cache = worker_cache(path, frequent)
        yield from _emit(pack_pieces(pieces(batches, cache), limits), TaskContext.get().partitionId())

    return docs.mapInArrow(lean(pack), SCHEMA)


def _emit(sequences: Iterator[list[Piece]], partition: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    out: list[tuple] = []
    for number, sequence in enumerate(sequences):
        offset = 0
        for p in sequence:
            out.append((p.key, p.start, p.length, zlib.crc32(p.ids.tobytes()) if p.ids is not None else None, p.total, (partition << 32) + number, offset))
            offset += p.length
        if len(out) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)


def pack_examples(examples: DataFrame, limits: Limits) -> DataFrame:
    """Whole (never cut) instruction examples with columns example_id, n_tokens, n_loss: rows (example_id, sequence_id, offset, status).

    An example beyond a limit is a row without sequence, status over-limit; all others are packed. Rows with a null or non-positive
    n_tokens have nothing to place and are empty; a null n_loss counts as n_tokens. Repeated rows are packed each.
    """
    counted = examples.selectExpr("cast(example_id as long) example_id", "cast(coalesce(n_tokens, 0) as long) n_tokens", "cast(coalesce(n_loss, n_tokens, 0) as long) n_loss")
    status = F.when(F.col("n_tokens") <= 0, "empty").when((F.col("n_tokens") > limits.tokens) | (F.col("n_loss") > limits.loss_tokens), "over-limit").otherwise("packed")
    schema = "example_id long, sequence_id long, offset long, status string"

    def pack(batches):
        from pyspark import TaskContext

        rest: list[tuple] = []  # of one batch

        def pieces():
            for batch in batches:
                for row in batch.to_pylist():
                    if row["status"] == "packed":
                        yield _Counted(row["example_id"], 0, row["n_tokens"], row["n_tokens"], marked=row["n_loss"])
                    else:
                        rest.append((row["example_id"], row["status"]))

        def aside():
            out, rest[:] = list(rest), []
            none = pa.nulls(len(out), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), none, none, pa.array([s for _, s in out], pa.string())], names=["example_id", "sequence_id", "offset", "status"])

        for batch in _emit(pack_pieces(pieces(), limits, cut=False), TaskContext.get().partitionId(), 2000):
            placed = batch.select(["doc_id", "sequence_id", "offset"]).rename_columns(["example_id", "sequence_id", "offset"])
            yield placed.append_column("status", pa.array(["packed"] * len(placed), pa.string()))
            if rest:
                yield aside()
        if rest:
            yield aside()

    return counted.withColumn("status", status).mapInArrow(pack, schema)


@dataclass
class _Counted(Piece):
    """A piece of which only the number of loss-bearing tokens is known."""

    marked: int = 0

    def loss_tokens(self, upto: int | None = None) -> int:
        return self.marked


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path())


#: Limits of packed conversations: tokens, conversations, and assistants' tokens of a sequence.
CONVERSATIONS = Limits(4096, 4, 3072)


def conversation_examples(turns: DataFrame, path: str) -> DataFrame:
    """example_id, n_tokens, n_loss of every conversation: all its tokens, and those of the assistant's turns."""
    rows = turns.select(F.col("conv_id").cast("long").alias("doc_id"), "text", F.coalesce("role", F.lit("")).alias("role"))
    counted = lambda part: token_counts(part, path).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    whole, loss = counted(rows), counted(rows.filter("role = 'assistant'")).withColumnRenamed("n", "loss").withColumnRenamed("doc_id", "other")
    joined = whole.join(loss, F.col("doc_id").eqNullSafe(F.col("other")), "left")
    return joined.select(F.col("doc_id").alias("example_id"), F.col("n").alias("n_tokens"), F.coalesce("loss", F.lit(0)).alias("n_loss"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, whole, into sequences under three limits of which each binds somewhere."""
    return pack_examples(conversation_examples(table(spark, sf_dir, "conversations"), tokenizer_path()), CONVERSATIONS)
