"""Benchmark decontamination by template canonicalisation.

Words lose surrounding punctuation and case; words with digits become the placeholder number, unit words after a number the
placeholder unit, and capitalised words inside a sentence the placeholder name. The hashes of all windows of five such words are
looked up in the table of the benchmark's windows. A document leaks an item when, along one alignment (a few words of drift are
allowed), it holds at least `containment` of the item's windows and its slot values are consistent: each number, unit or name
of the item stands for one value throughout the passage. So copies, near copies and re-parameterised questions are caught.

Windows with fewer than three literal words prove nothing and count for neither side; items without any window can't be found.
The benchmark is taken in blocks of at most `block_words` words, each broadcast (a bound on its size) and run over all rows:
documents are never shuffled. Null text or null item text counts as empty and matches nothing; null doc_id is reported as null;
repeated rows are reported each, repeated items each under their item_id; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import id_and_text, lean, small_batches, span_hashes, table
from heronry.llm.words import FOLD, Texts, slices, windows

WIDTH = 5
LEAST_LITERALS = 3
DRIFT = 4
#: Units of measure and money (fixed values).
UNITS = "mm cm m km inch inches feet foot yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kph kmh watt watts volt volts byte bytes kb mb gb tb".split()
#: Placeholders: 0 is a literal word.
NUMBER, UNIT, NAME = 1, 2, 3
MARK = np.zeros(256, bool)
MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?:")] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
PLACEHOLDER = np.array([0, 0x1F3A5C7E9B2D4F61, 0x2E4B6D8FA1C3E507, 0x3D5C7B9AB8D6F415], np.uint64)
SCHEMA = "doc_id long, item_id long, matched_windows long, item_windows long, containment double, slots long, changed_slots long, first_word long, last_word long"


def _hash_of(words: list[str]) -> np.ndarray:
    data = b"\n".join(w.encode() for w in words)
    texts = Texts([data])
    return texts.hashes()


UNIT_HASHES = np.sort(_hash_of(UNITS))


class Templates:
    """Canonical words of some texts: `values` (hash of the literal word), `kinds`, `codes` (value or placeholder), `owner`; `codes5` and `solid` by first word of a window."""

    def __init__(self, texts: list[bytes]):
        words = Texts(texts)
        data, starts, ends = words.data, words.starts.copy(), words.ends.copy()
        raw_start, raw_end = words.starts, words.ends
        for _ in range(8):
            starts += (starts < ends) & MARK[data[np.minimum(starts, len(data) - 1)]]
            ends -= (ends > starts) & MARK[data[ends - 1]]
        kept = ends > starts
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        opens = np.ones(len(starts), bool)
        if len(starts) > 1:
            opens[1:] = STOP[data[raw_end[:-1] - 1]] | (lines[raw_start[1:]] != lines[raw_end[:-1]])
        digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
        number = digits[ends] > digits[starts]
        second = data[np.minimum(starts + 1, len(data) - 1)]
        name = CAPITAL[data[np.minimum(starts, len(data) - 1)]] & ~opens & ~(CAPITAL[second] & (ends - starts > 1))
        values = span_hashes(FOLD[data], starts, ends)[kept]
        number, name, self.owner = number[kept], name[kept], words.owner[kept]
        unit = np.zeros(len(values), bool)
        if len(values) > 1:
            at = np.minimum(np.searchsorted(UNIT_HASHES, values), len(UNIT_HASHES) - 1)
            unit[1:] = (UNIT_HASHES[at] == values)[1:] & number[:-1] & (self.owner[1:] == self.owner[:-1])
        self.values = values
        self.kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, 0)))
        self.codes = np.where(self.kinds > 0, PLACEHOLDER[self.kinds], values)
        self.windows = windows(self.codes, WIDTH)
        n = len(self.windows)
        literal = np.concatenate([[0], np.cumsum(self.kinds == 0)])
        self.solid = (self.owner[:n] == self.owner[WIDTH - 1 :]) & (literal[WIDTH:] - literal[:-WIDTH] >= LEAST_LITERALS) if n else np.zeros(0, bool)
        self.first = np.searchsorted(self.owner, np.arange(words.n))


@dataclass
class Item:
    item_id: int
    values: np.ndarray
    kinds: np.ndarray
    windows: np.ndarray  # hashes of the windows that count, and their positions
    positions: np.ndarray

    @property
    def total(self) -> int:
        return len(self.positions)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for all values of all ranges low .. high - 1."""
    count = high - low
    number = np.repeat(np.arange(len(low)), count)
    return number, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[number]


class Block:
    """Items of the benchmark and their windows, sorted by hash."""

    def __init__(self, rows: list[tuple[int, str]]):
        templates = Templates([(text or "").encode() for _, text in rows])
        bounds = np.append(templates.first, len(templates.values))
        self.items, hashes, owners = [], [], []
        for k, (item_id, _) in enumerate(rows):
            a, b = bounds[k], bounds[k + 1]
            at = a + np.flatnonzero(templates.solid[a : max(a, b - WIDTH + 1)])
            order = np.argsort(templates.windows[at], kind="stable")
            self.items.append(Item(item_id, templates.values[a:b], templates.kinds[a:b], templates.windows[at][order], (at - a)[order]))
            hashes.append(templates.windows[at])
            owners.append(np.full(len(at), k))
        hashes, owners = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.totals = np.array([item.total for item in self.items])
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def leaks(self, texts: list[bytes], containment: float, most: int = 1_000_000):
        """(number of the text, item, matched windows, slots, changed slots, first word, last word) of every leak.

        Which items can be leaked is counted from each text's distinct windows, about `most` (window, item) pairs at a time; so a
        window that a text repeats or that many items share costs each text and item once.
        """
        if not len(self.hashes):
            return
        templates = Templates(texts)
        near = np.flatnonzero(self.gate[(templates.windows >> np.uint64(44)).astype(np.int64)] & templates.solid)
        found = templates.windows[near]
        low, high = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        hit = high > low
        near, low, high, found = near[hit], low[hit], high[hit], found[hit]
        if not len(near):
            return
        owner = templates.owner[near]
        order = np.lexsort((near, found, owner))
        near, low, high, found, owner = near[order], low[order], high[order], found[order], owner[order]
        first = np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])]
        u_low, u_high, u_owner = low[first], high[first], owner[first]
        ends = np.r_[np.flatnonzero(u_owner[1:] != u_owner[:-1]) + 1, len(u_owner)]
        size, start = np.concatenate([[0], np.cumsum(u_high - u_low)]), 0
        while start < len(u_owner):  # whole texts, and at least one
            fitting = ends[(ends > start) & (size[ends] - size[start] <= most)]
            stop = fitting[-1] if len(fitting) else ends[np.searchsorted(ends, start, side="right")]
            number, entry = _ranges(u_low[start:stop], u_high[start:stop])
            pairs, counts = np.unique(u_owner[start:stop][number].astype(np.int64) * len(self.items) + self.owners[entry], return_counts=True)
            able = counts >= np.ceil(containment * self.totals[pairs % len(self.items)] - 1e-9)
            for pair in pairs[able].tolist():
                text, k = divmod(pair, len(self.items))
                part = slice(*np.searchsorted(owner, [text, text + 1]))
                if row := self._judge(templates, text, self.items[k], near[part], found[part], containment):
                    yield (text, *row)
            start = stop

    def _judge(self, templates: Templates, owner: int, item: Item, near: np.ndarray, found: np.ndarray, containment: float):
        """near, found: places and hashes of the text's windows, by hash."""
        low, high = np.searchsorted(item.windows, found, "left"), np.searchsorted(item.windows, found, "right")
        number, entry = _ranges(low, high)
        at, position = near[number] - int(templates.first[owner]), item.positions[entry]
        order = np.lexsort((position, at - position))
        at, position = at[order], position[order]
        shift = at - position
        # the alignment with most matched windows: shifts within DRIFT of one another
        best, reach = None, np.searchsorted(shift, shift + DRIFT, side="right")
        least, whole = int(np.ceil(containment * item.total - 1e-9)), len(np.unique(position))
        begins = np.flatnonzero(np.r_[True, shift[1:] != shift[:-1]])
        for a in begins[reach[begins] - begins >= least].tolist():
            if best is not None and reach[a] - a <= best[0]:
                continue
            matched = len(np.unique(position[a : reach[a]]))
            if matched >= least and (best is None or matched > best[0]):
                best = (matched, slice(a, reach[a]))
                if matched == whole:
                    break
        if best is None:
            return None
        base, slots = int(templates.first[owner]), {}
        places, positions = at[best[1]], position[best[1]]
        for place, p in zip(places.tolist(), positions.tolist(), strict=True):
            for j in range(WIDTH):
                if item.kinds[p + j]:
                    slots.setdefault((p + j), templates.values[base + place + j])
        bound: dict[tuple[int, int], int] = {}
        clashes = changed = 0
        for p, value in slots.items():
            key = (int(item.kinds[p]), int(item.values[p]))
            clashes += bound.setdefault(key, int(value)) != int(value)
            changed += int(item.values[p]) != int(value)
        if clashes * 5 > len(slots):
            return None
        return item, best[0], len(slots), changed, int(places.min()), int(places.max()) + WIDTH - 1


def blocks(benchmark: DataFrame, block_words: int = 500_000):
    """The benchmark in blocks of bounded size; rows stream to the driver one block at a time."""
    rows, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        rows.append((row.item_id, row.text))
        size += row.text.count(" ") + 1
        if size >= block_words:
            yield Block(rows)
            rows, size = [], 0
    if rows:
        yield Block(rows)


def leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.5) -> DataFrame:
    """One row per document row and item that it leaks."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    spark = docs.sparkSession

    def search(shared):
        def run(batches):
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for first, texts in slices(batch.column("text")):
                    for owner, item, matched, slots, changed, a, b in shared.value.leaks(texts, containment):
                        rows.append((ids[first + owner].as_py(), item.item_id, matched, item.total, matched / item.total, slots, changed, a, b))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return lean(run)

    parts = [docs.mapInArrow(search(spark.sparkContext.broadcast(block)), SCHEMA) for block in blocks(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text leaks no item."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    small_batches(spark)

    def keep(shared):
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, texts in slices(batch.column(at)):
                    for owner, *_ in shared.value.leaks(texts, containment):
                        clean[first + owner] = False
                yield batch.filter(pa.array(clean))

        return lean(run)

    for block in blocks(benchmark):
        docs = docs.mapInArrow(keep(spark.sparkContext.broadcast(block)), docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
