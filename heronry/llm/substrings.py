r"""Substring deduplication by difference-cover anchors: words of passages that stand anywhere else go.

A window is `WINDOW` consecutive words. A word goes when a window over it stands at another place too, in the same or another
document; windows are judged on the input.

1. Anchors. COVER is a difference cover modulo PERIOD: for any two positions i and j there is a shift below PERIOD that brings both
   to cover positions. So two equal windows always hold an equal run of WINDOW - PERIOD + 1 words at an aligned cover position of
   both, wherever the documents begin. Only these runs are hashed and looked for: 4 of 13 positions.
2. Extension. Each window over an anchor that stands at several places is hashed whole, and looked for in the same way.
3. The words of the windows found are taken out.

Texts are put into chunks of bounded bytes once and written as a table bucketed by chunk. Codes go from there to buckets by hash; back
comes, for each chunk, which of its places are shared; so texts are never shuffled, and chunk and answer meet without one. A code that
a task has several times is sent once, with that mark: a passage that stands in a third of all rows costs each task one code. A bucket
is held in memory at a time, and the number of buckets grows with the bytes of the corpus.

Codes are hashes, of 32 bits for anchors, as a bucket holds some million of them and a chance match only has a window hashed in vain,
and of 64 bits for windows, told apart further by their bucket. Null text has no words; null doc_id stays null; rows that repeat a doc_id
are texts of their own, and repeated rows repeat their windows; texts of fewer than WINDOW words lose nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import BASE, MIX_A, MIX_B, id_and_text, lean, mix64, small_batches, span_hashes, table
from heronry.llm.words import Texts
from heronry.scratch import scratch_path

WINDOW = 35
#: A difference cover: each residue modulo PERIOD is the difference of two of its members (fixed values).
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a chunk's texts (a longer text is a chunk of its own), of texts to a bucket, and codes that a task holds before it sends them.
CHUNK, PER_BUCKET, HELD = 1 << 20, 16 << 20, 1_000_000
CHUNKS = "chunk long, docs array<struct<doc_id: bigint, text: string>>"
DOC = pa.struct([("doc_id", pa.int64()), ("text", pa.string())])
SENT = "bucket long, chunks binary, counts binary, codes binary, gaps binary, repeats binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of doc_id and text in chunks of about CHUNK bytes, numbered by task and order."""

    def run(batches):
        task, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def full():
            rows = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], fields=list(DOC))
            column = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), column], names=["chunk", "docs"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                length = len(text.as_buffer()) if text.as_buffer() is not None else 0
                if ids and size + length > CHUNK:
                    yield full()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text.as_py())
                size += length
        if ids:
            yield full()

    return docs.mapInArrow(lean(run), CHUNKS)


def stored(chunks: DataFrame, buckets: int) -> DataFrame:
    """The chunks as a table in shared storage, bucketed by chunk; the catalogue does not keep the table."""
    spark, name = chunks.sparkSession, f"heronry_{uuid.uuid4().hex}"
    writer = chunks.write.format("parquet").bucketBy(buckets, "chunk").option("path", scratch_path(spark, "chunks"))
    # Rows are large: row groups and pages are measured after each of them, and stay small enough for a reader's batch.
    for key, value in (("compression", "zstd"), ("parquet.block.size", 16 << 20), ("parquet.page.size.row.check.min", 1), ("parquet.block.size.row.check.min", 1)):
        writer = writer.option(key, value)
    writer.saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as the table is external
    return out


def window_codes(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, bucket hash) of the runs of `width` words from each of `starts` on: differences of two running sums with their own factors."""
    with np.errstate(over="ignore"):
        out = []
        for factor in (BASE, MIX_A):
            power = np.ones(len(hashes) + 1, np.uint64)
            power[1:] = factor
            power = np.multiply.accumulate(power)
            total = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * power[:-1], out=total[1:])
            back = pow(int(factor), -1, 1 << 64)
            down = np.ones(len(hashes) + 1, np.uint64)
            down[1:] = np.uint64(back)
            down = np.multiply.accumulate(down)
            out.append(mix64((total[starts + width] - total[starts]) * down[starts] + MIX_B))
        return out[0], out[1]


def narrow(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as bytes: their width, then each in 2 or 4 bytes."""
    width = 2 if not len(numbers) or numbers.max() < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Chunk:
    """Word hashes of a chunk's texts, each word's place in its text, and how many words of the text stand from it on."""

    def __init__(self, texts: list[bytes]):
        words = Texts(texts)
        self.hashes = span_hashes(words.data, words.starts, words.ends)
        counts = np.bincount(words.owner, minlength=words.n)
        first = np.cumsum(counts) - counts
        self.place = np.arange(len(self.hashes)) - first[words.owner]
        self.left = counts[words.owner] - self.place
        self.length = counts[words.owner]

    def anchors(self) -> np.ndarray:
        """Words at which an anchor begins, of texts that hold a window."""
        return np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= ANCHOR) & (self.length >= WINDOW))

    def windows_over(self, anchors: np.ndarray) -> np.ndarray:
        """Words at which a window that holds one of these anchors begins."""
        step = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(step, anchors - np.minimum(self.place[anchors], PERIOD - 1), 1)
        np.add.at(step, anchors + 1, -1)
        return np.flatnonzero((np.cumsum(step)[:-1] > 0) & (self.left >= WINDOW))


def _texts(batch, row) -> list[bytes]:
    return [(doc["text"].as_py() or "").encode() for doc in batch.column("docs")[row].values]


def sent(rows: DataFrame, buckets: int, codes_of) -> DataFrame:
    """Codes by bucket, and, in bucket -1 - task, places that a task knows itself to be shared.

    codes_of(batch, row) gives (chunk, places, codes, bucket hashes). Rows of SENT pack many codes: chunks and counts (whose codes follow
    each other), codes, gaps between places, and repeats: the task has the code more than once.
    """

    def dealt(held):
        chunk = np.concatenate([np.full(len(p), c) for c, p, _, _ in held])
        place, code, other = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        bucket = (other % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((code, bucket))
        chunk, place, code, bucket = chunk[order], place[order], code[order], bucket[order]
        fresh = np.r_[True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])]
        group = np.cumsum(fresh) - 1
        many = np.bincount(group) > 1
        known = many[group]
        if known.any():
            yield packed(np.full(known.sum(), -1 - TaskContext.get().partitionId()), chunk[known], place[known], np.zeros(0, np.uint64), np.zeros(0, bool))
        yield packed(bucket[fresh], chunk[fresh], place[fresh], code[fresh], many)

    def packed(bucket, chunk, place, code, repeats):
        order = np.lexsort((place, chunk, bucket))
        bucket, chunk, place = bucket[order], chunk[order], place[order]
        if len(code):
            code, repeats = code[order], repeats[order]
        runs = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (bucket[1:] != bucket[:-1])])
        counts = np.diff(np.r_[runs, len(bucket)]).astype(np.int32)
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cuts[1:], len(bucket)]
        part = lambda x, at, to: pa.array([x[a:b].tobytes() for a, b in zip(at, to, strict=True)], pa.binary())
        low, high = np.searchsorted(runs, cuts), np.searchsorted(runs, ends)
        gaps = np.diff(place, prepend=0)
        gaps[runs] = place[runs]
        between = pa.array([narrow(gaps[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())
        columns = [pa.array(bucket[cuts]), part(chunk[runs], low, high), part(counts, low, high), part(code, cuts, ends), between, part(np.asarray(repeats, bool), cuts, ends)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunks", "counts", "codes", "gaps", "repeats"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                found = codes_of(batch, row)
                if len(found[1]):
                    held.append(found)
                    size += len(found[1])
                if size > HELD:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    return rows.mapInArrow(lean(run), SENT)


def answered(codes: DataFrame, buckets: int) -> DataFrame:
    """chunk and the gaps between its places, packed, whose code stands at another place too: one row for each chunk."""

    def places(gaps: bytes, counts: np.ndarray) -> np.ndarray:
        each = widened(gaps)
        run, first = np.cumsum(each), np.cumsum(counts) - counts
        return run - np.repeat(run[first] - each[first], counts)

    def joined(rows):
        counts = [np.frombuffer(r[2], np.int32) for r in rows]
        chunk = np.repeat(np.concatenate([np.frombuffer(r[1], np.int64) for r in rows]), np.concatenate(counts))
        place = np.concatenate([places(r[4], c) for r, c in zip(rows, counts, strict=True)])
        shared = np.ones(len(place), bool)
        if rows[0][0] >= 0:
            code = np.concatenate([np.frombuffer(r[3], f"<u{len(r[3]) // int(c.sum())}") for r, c in zip(rows, counts, strict=True)])
            repeats = np.concatenate([np.frombuffer(r[5], bool) for r in rows])
            order = np.argsort(code, kind="stable")
            fresh = np.r_[True, code[order][1:] != code[order][:-1]]
            group = np.empty(len(code), np.int64)
            group[order] = np.cumsum(fresh) - 1
            shared = (np.bincount(group)[group] > 1) & ~repeats  # the others' task knows already
            known = np.zeros(group.max() + 1, bool)
            known[group[repeats]] = True
            shared |= known[group] & ~repeats
        chunk, place = chunk[shared], place[shared]
        order = np.lexsort((place, chunk))
        chunk, place = chunk[order], place[order]
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, int)
        ends = np.r_[cuts[1:], len(chunk)].astype(int)[: len(cuts)]
        gaps = [narrow(np.diff(place[a:b], prepend=0)) for a, b in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts], pa.int64()), pa.array(gaps, pa.binary())], names=["chunk", "gaps"])

    def run(batches):
        rows = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and rows[0][0] != row[0]:
                    yield joined(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield joined(rows)

    by_bucket = codes.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return by_bucket.mapInArrow(lean(run), "chunk long, gaps binary").groupBy("chunk").agg(F.collect_list("gaps").alias("gaps"))


def _with_places(chunks: DataFrame, places: DataFrame, how: str) -> DataFrame:
    return chunks.join(places.hint("shuffle_hash"), "chunk", how)


def _places(batch, row) -> np.ndarray:
    parts = batch.column("gaps")[row]
    return np.sort(np.concatenate([np.cumsum(widened(p.as_py())) for p in parts.values])) if parts.is_valid and len(parts) else np.zeros(0, np.int64)


def repeated_windows(chunks: DataFrame, buckets: int) -> DataFrame:
    """chunk and places: words (counted over the chunk) at which a window begins that stands anywhere else too."""

    def anchors(batch, row):
        chunk = Chunk(_texts(batch, row))
        at = chunk.anchors()
        code, bucket = window_codes(chunk.hashes, at, ANCHOR)
        return batch.column("chunk")[row].as_py(), at, (code >> np.uint64(32)).astype(np.uint32), bucket

    def extended(batch, row):
        chunk = Chunk(_texts(batch, row))
        at = chunk.windows_over(_places(batch, row))
        return batch.column("chunk")[row].as_py(), at, *window_codes(chunk.hashes, at, WINDOW)

    shared = answered(sent(chunks, buckets, anchors), buckets)
    return answered(sent(_with_places(chunks, shared, "inner"), buckets, extended), buckets)


KEPT = "doc_id long, text string, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_and_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_BUCKET))
    chunks = stored(chunked(rows), buckets)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                docs, first = batch.column("docs")[row].as_py(), 0
                starts, out = _places(batch, row), []
                for doc in docs:
                    words = (doc["text"] or "").encode().split()
                    step = np.zeros(len(words) + 1, np.int32)
                    a, b = np.searchsorted(starts, [first, first + len(words)])
                    own = starts[a:b] - first
                    step[own] += 1
                    step[own + WINDOW] -= 1
                    stay = np.cumsum(step)[:-1] == 0
                    out.append((doc["doc_id"], doc["text"], len(words), int(len(words) - stay.sum()), b" ".join(compress(words, stay)).decode()))
                    first += len(words)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "text", "n_words", "n_removed", "kept"])

    return _with_places(chunks, repeated_windows(chunks, buckets), "left").mapInArrow(lean(run), KEPT)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, as counts and a digest."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
g AS (SELECT DISTINCT r, i + k AS at FROM (SELECT s.r, s.i FROM s JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)), range(35) t(k)),
k AS (
  SELECT x.r, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.at) AS kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d) x ANTI JOIN g ON g.r = x.r AND g.at = x.at
  GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
