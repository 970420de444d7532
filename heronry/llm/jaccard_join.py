"""Exact Jaccard join of documents on word shingles, in the metric space of shingle sets.

Documents with equal shingle sets are one class. Two classes link when their Jaccard distance is at most 1/4.

1. First-level regions. Between most documents of a corpus the distance is 1, also to any document chosen as pivot, so windows
   around document pivots would hold everything. The pivots of the first level are therefore single shingles: a set is near {s} if
   it holds s. A set of n shingles is replicated to the regions of its n - ceil(3n/4) + 1 first shingles in one fixed order that puts
   widespread shingles last; sets at distance 1/4 or less share such a region, so no link is lost.
2. Stars. Each member of a region is compared with the region's smallest member; what links is one component. Pairs inside a
   component need no comparison.
3. Voronoi regions. Regions that hold several components and many members are divided by document pivots: each member is at home
   with its nearest pivot, and goes as boundary document to each other region whose pivot is within the region's radius plus the
   member's reach (triangle inequality). Regions are divided again while that saves comparisons, on the cluster while they have more
   than `LARGE` members, in one task below; what can't be divided further is compared in pairs of blocks of bounded size. The
   metric is the symmetric difference of bitmaps of shingle parities, which never exceeds that of the sets: a set of n shingles
   reaches n/3, as sets at Jaccard distance 1/4 or less differ in (n + 4n/3)/7 shingles at most. So no link is lost here either.
4. Each member is first compared with the nearest of each other component, then with all that are left. Each pair that bounds do
   not rule out is decided by the exact intersection of the two sets.

Sets are recomputed from the texts of those documents that are compared rather than shuffled for all; regions with the same members
count once, and a shingle of very many members is dealt over several tasks. Shingles travel as 64-bit hashes and classes as 64-bit
sums of them.

A document with fewer than five words has its whole sequence as one shingle; without words (or text) it has none, links with nothing
and is its own component. Rows that repeat a doc_id form one document id with links of each of its texts; a null doc_id is never a
component's smallest id unless all are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import arrow_batches, id_and_text, lean, mix64, table
from heronry.llm.words import shingle_sets, slices
from heronry.operators.graph import connected_components
from heronry.scratch import persisted

WIDTH = 5
PARITIES = 2048
#: How many shingles that repeat within a task are kept, by falling number of repeats; it changes speed alone.
MOST_WIDESPREAD = 1_000_000
#: Entries of first-level regions that one task gathers; a shingle with more of them is dealt over several tasks.
GATHERED = 250_000
#: Members of a region from which on it is divided on the cluster, and of one that a task compares without dividing it.
LARGE, LEAF = 2048, 128
#: Members of a region up to which its pairs are made together with those of other small regions; members that one task gets together.
SMALL, PACKED = 32, 20_000
PIVOTS, LEVELS = 32, 4
FILTER_BITS = 23
#: Codes that a task holds before it counts them, and rows and bytes of an Arrow batch: they bound the memory of a Python worker.
HELD, ROWS, BYTES = 1_500_000, 1000, 4 << 20


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (3 * n + 3) // 4 + 1


def _sets(texts):
    """(first row, shingle counts, classes, owner and hash of every shingle) for each slice of a column of texts."""
    for first, part in slices(texts, rows=512):
        owner, codes = shingle_sets(part, WIDTH)
        sizes = np.bincount(owner, minlength=len(part))
        classes = np.zeros(len(part), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(classes, owner, mix64(codes + np.uint64(1)))
        yield first, sizes, classes.view(np.int64), owner, codes


class _Fresh:
    """Which classes a task has not seen lately; what it remembers is bounded."""

    def __init__(self, most: int = 50_000):
        self.seen, self.most = set(), most

    def of(self, classes: np.ndarray) -> np.ndarray:
        if len(self.seen) > self.most:
            self.seen.clear()
        return np.array([not (c in self.seen or self.seen.add(c)) for c in classes.tolist()], bool)


def _bitmaps(sizes: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> list[bytes]:
    """Parities of the shingles by slot; larger sets have more slots, a multiple of PARITIES."""
    rows = len(sizes)
    parity = (np.bincount(owner * PARITIES + (codes % np.uint64(PARITIES)).astype(np.int64), minlength=rows * PARITIES) & 1).astype(bool)
    packed = [p.tobytes() for p in np.packbits(parity.reshape(rows, PARITIES), axis=1)]
    stop = np.cumsum(sizes)
    for i in np.flatnonzero(2 * sizes > PARITIES).tolist():
        width = 1 << int(2 * sizes[i] - 1).bit_length()
        slots = (codes[stop[i] - sizes[i] : stop[i]] % np.uint64(width)).astype(np.int64)
        packed[i] = np.packbits((np.bincount(slots, minlength=width) & 1).astype(bool)).tobytes()
    return packed


DESCRIBED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("parities", pa.binary()), ("shingle", pa.int64()), ("repeats", pa.int64())])


def describe(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: doc_id, key, n, class and parities of every document; and shingle, repeats of shingles that repeat in a task."""

    def rows(count: int, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in DESCRIBED], schema=DESCRIBED)

    def repeats(held: list[np.ndarray]):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        for at in range(0, len(values), 100_000):
            part = values[at : at + 100_000]
            yield rows(len(part), shingle=pa.array(part.view(np.int64)), repeats=pa.array(counts[at : at + 100_000].astype(np.int64)))

    def run(batches):
        held, size, fresh = [], 0, _Fresh()
        for batch in batches:
            for first, sizes, classes, owner, codes in _sets(batch.column("text")):
                n = len(sizes)
                yield rows(n, doc_id=batch.column("doc_id").slice(first, n), key=batch.column("key").slice(first, n), n=pa.array(sizes.astype(np.int64)), **{"class": pa.array(classes)}, parities=pa.array(_bitmaps(sizes, owner, codes), pa.binary()))
                held.append(codes[fresh.of(classes)[owner]])
                size += len(held[-1])
                if size > HELD:
                    yield from repeats(held)
                    held, size = [], 0
        if held:
            yield from repeats(held)

    return docs.mapInArrow(lean(run), "doc_id long, key long, n long, class long, parities binary, shingle long, repeats long")


@dataclass
class Order:
    """The most repeated shingles, sorted, with the logarithm of their repeats, and those of them that need several tasks."""

    codes: np.ndarray
    levels: np.ndarray
    hot: np.ndarray
    salts: int

    def of(self, codes: np.ndarray) -> np.ndarray:
        """0 for shingles not known as widespread, more for more widespread ones."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int8)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.levels[at], 0)


def _order(described: DataFrame) -> Order:
    """At most MOST_WIDESPREAD shingles (9 MB)."""
    counts = described.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("repeats").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST_WIDESPREAD).select("shingle", "n").toArrow()
    codes, n = top["shingle"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64)
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    return Order(codes, np.ceil(2 * np.log2(np.maximum(n, 1))).astype(np.int8), codes[n > GATHERED], int(-(-n[n > GATHERED].sum() // GATHERED)))


def _within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def regions(docs: DataFrame, order: Order, entries: int) -> DataFrame:
    """region, class, n: members of every first-level region with two members or more; regions of the same members once."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    bits = max(5, int(np.ceil(np.log2(max(1, entries / GATHERED)))))

    def blobs(code, cls, n):
        bucket = (code >> np.uint64(64 - bits)).astype(np.int64)
        if len(shared.value.hot):
            hot = _within(shared.value.hot, code)
            bucket[hot] = (1 << bits) + (mix64(cls[hot].view(np.uint64)) % np.uint64(shared.value.salts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        code, cls, n, bucket = code[order], cls[order], n[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cuts[1:], len(bucket)]
        part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), part(code), part(cls), part(n)], names=["bucket", "codes", "classes", "sizes"])

    def emit(batches):
        held, size, seen = [], 0, _Fresh()
        for batch in batches:
            for _, sizes, classes, owner, codes in _sets(batch.column("text")):
                keep = seen.of(classes)[owner]
                owner, codes = owner[keep], codes[keep]
                rank = np.lexsort((codes, shared.value.of(codes), owner))
                owner, codes = owner[rank], codes[rank]
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                first = place < prefix_length(sizes)[owner]
                owner, codes = owner[first], codes[first]
                held.append((codes, classes[owner], sizes[owner].astype(np.int32)))
                size += len(codes)
                if size > HELD // 4:
                    yield blobs(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield blobs(*map(np.concatenate, zip(*held, strict=True)))

    def gather(group: pa.Table) -> pa.Table:
        code, cls, n = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(c)]) for c, kind in (("codes", np.uint64), ("classes", np.int64), ("sizes", np.int32)))
        salted = group.column("bucket")[0].as_py() >= 1 << bits
        order = np.lexsort((cls, code))
        code, cls, n = code[order], cls[order], n[order]
        fresh = np.r_[True, (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])]
        code, cls, n = code[fresh], cls[fresh], n[fresh]
        if salted:  # other tasks hold more of the same regions
            return pa.table([mix64(code).view(np.int64), cls, n.astype(np.int64)], names=["region", "class", "n"])
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        count = np.diff(np.r_[start, len(code)])
        with np.errstate(over="ignore"):
            mark = np.add.reduceat(mix64(cls.view(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
        chosen = np.flatnonzero(count > 1)
        _, once = np.unique(mark[chosen], return_index=True)
        chosen = np.sort(chosen[once])
        take = np.repeat(start[chosen], count[chosen]) + (np.arange(count[chosen].sum()) - np.repeat(np.cumsum(count[chosen]) - count[chosen], count[chosen]))
        return pa.table([np.repeat(mark[chosen], count[chosen]).view(np.int64), cls[take], n[take].astype(np.int64)], names=["region", "class", "n"])

    found = docs.mapInArrow(lean(emit), "bucket long, codes binary, classes binary, sizes binary").groupBy("bucket").applyInArrow(gather, "region long, class long, n long")
    return found.distinct()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer slots: slot s of the result is the sum of all slots that are s modulo the new number."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _same_width(x: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = min(len(x), len(y)) // 8
    return _folded(np.frombuffer(x, np.uint64), words), _folded(np.frombuffer(y, np.uint64), words)


def _table_of_bits(column) -> np.ndarray:
    """One row of PARITIES bits for each bitmap."""
    return np.stack([_folded(np.frombuffer(p.as_buffer(), np.uint64), PARITIES // 64) for p in column]) if len(column) else np.zeros((0, PARITIES // 64), np.uint64)


def _possible(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and parities do not rule out: popcount of the differing parities is at most the symmetric difference."""
    side = lambda x: kinds.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("parities").alias(f"p{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(na, nb) >= 3 * greatest(na, nb)")

    def judge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            least = np.array([np.bitwise_count(np.bitwise_xor(*_same_width(x, y))).sum() for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)])
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(7 * least.astype(np.int64) <= both))

    return rows.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(judge, "a long, b long")


# --- Voronoi regions -------------------------------------------------------------------------------------------------------


def distances(bits: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Symmetric differences of all bitmaps to each pivot's."""
    return np.stack([np.bitwise_count(bits ^ p).sum(axis=1, dtype=np.int64) for p in pivots], axis=1)


class Members:
    """Members of a region, or of several small ones: class, component (root), size, bitmap, whether they are at home there, region."""

    def __init__(self, cls, root, n, home, bits, block=None, cell=None):
        self.cls, self.root, self.n, self.home, self.bits, self.block, self.cell = cls, root, n, home, bits, block, cell

    def near(self, u: np.ndarray, v: np.ndarray):
        """(u, v, difference) of the pairs of members that sizes and bitmaps allow."""
        for t in range(0, len(u), 1 << 15):
            i, j = u[t : t + (1 << 15)], v[t : t + (1 << 15)]
            least = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64)
            ok = 7 * least <= self.n[i] + self.n[j]
            yield i[ok], j[ok], least[ok]

    def compared(self, home: np.ndarray, guests: np.ndarray):
        """All pairs of home members, and of home members and guests, that are of different components."""
        everyone = np.concatenate([home, guests])
        for s in range(0, len(home), 64):
            part = home[s : s + 64]
            n, m = self.n[part][:, None], self.n[everyone][None, :]
            ok = (self.root[part][:, None] != self.root[everyone]) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (np.arange(s, s + len(part))[:, None] < np.arange(len(everyone)))
            if self.block is not None:
                ok &= self.block[part][:, None] != self.block[everyone]
            i, j = np.nonzero(ok)
            yield from self.near(part[i], everyone[j])

    def joined(self, home: np.ndarray, guests: np.ndarray):
        """As compared(), by division at pivots as long as that saves comparisons."""
        work = len(home) * (len(home) + len(guests))
        if len(home) <= LEAF or self.block is not None:
            yield from self.compared(home, guests)
            return
        pivots = home[:: max(1, len(home) // min(PIVOTS, 2 * len(home) // LEAF))][:PIVOTS]
        own, other = distances(self.bits[home], self.bits[pivots]), distances(self.bits[guests], self.bits[pivots])
        nearest, cells = own.argmin(axis=1), []
        for k in range(len(pivots)):
            here = nearest == k
            if here.any():
                radius = own[here, k].max()
                inside = np.concatenate([home[(nearest > k) & (3 * own[:, k] <= 3 * radius + self.n[home])], guests[3 * other[:, k] <= 3 * radius + self.n[guests]]])
                cells.append((home[here], inside))
        if sum(len(h) * (len(h) + len(g)) for h, g in cells) > 0.7 * work:
            yield from self.compared(home, guests)
            return
        for h, g in cells:
            yield from self.joined(h, g)

    def neighbours(self):
        """As compared(), for all pairs of each of many small regions: members are sorted by region, so pairs stand close together."""
        cell = self.cell
        for step in range(1, SMALL):
            i = np.flatnonzero((cell[:-step] == cell[step:]) & (self.root[:-step] != self.root[step:]))
            i = i[(self.home[i] | self.home[i + step]) & (4 * np.minimum(self.n[i], self.n[i + step]) >= 3 * np.maximum(self.n[i], self.n[i + step]))]
            yield from self.near(i, i + step)

    def pairs(self, small: bool, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes (a, b) of the pairs that are left, and the regions that have more of them.

        With whole=False a region that has more than two pairs a member gives the nearest pair of each member alone, and is named.
        """
        found = list(self.neighbours() if small else self.joined(np.flatnonzero(self.home), np.flatnonzero(~self.home)))
        i, j, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        if whole or not len(i):
            return self.cls[i], self.cls[j], np.zeros(0, np.int64)
        cells, sizes = np.unique(self.cell, return_counts=True)
        where = np.searchsorted(cells, self.cell[i])
        crowded = np.bincount(where, minlength=len(cells)) > 2 * sizes
        full = crowded[where]
        u, v, far = np.concatenate([i[full], j[full]]), np.concatenate([j[full], i[full]]), np.concatenate([d[full], d[full]])
        order = np.lexsort((v, far, u))
        u, v = u[order], v[order]
        first = np.r_[True, u[1:] != u[:-1]] if len(u) else np.zeros(0, bool)
        i, j = np.concatenate([i[~full], u[first]]), np.concatenate([j[~full], v[first]])
        return self.cls[i], self.cls[j], cells[crowded]


CELL = "cell long, origin long, class long, root long, n long, home boolean"
CELLS = [x.split()[0] for x in CELL.split(", ")]


def divided(members: DataFrame, kinds: DataFrame, level: int) -> DataFrame:
    """The members of large regions (columns of CELL and the region's size) in smaller ones, by document pivots."""
    step = F.greatest(F.lit(1), F.floor(F.col("size") / PIVOTS))
    known = members.join(kinds.select("class", "parities"), "class")
    pivots = known.filter("home").filter(F.pmod(F.xxhash64("class", F.lit(level)), step) == 0).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("class", "parities"))).alias("p"))
    known = known.join(pivots.select("cell", F.col("p.parities").alias("pivots")), "cell", "left")

    def measure(batches):
        for batch in batches:
            bits, rows = _table_of_bits(batch.column("parities")), []
            for b, pivots in zip(bits, batch.column("pivots"), strict=True):
                rows.append(distances(b[None, :], _table_of_bits(pivots.values))[0].tolist() if pivots.is_valid and len(pivots) else [0])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in CELLS], pa.array(rows, pa.list_(pa.int64()))], names=[*CELLS, "d"])

    measured = known.select(*CELLS, "parities", "pivots").mapInArrow(measure, f"{CELL}, d array<long>")
    measured = persisted(measured.withColumn("nearest", F.when(F.col("home"), F.array_position("d", F.array_min("d")) - 1)), "distances")
    radius = measured.filter("home").groupBy("cell", "nearest").agg(F.max(F.array_min("d")).alias("radius")).groupBy("cell").agg(F.collect_list(F.struct(F.col("nearest").alias("k"), "radius")).alias("cells"))
    placed = measured.join(radius, "cell").select("*", F.explode("cells").alias("c")).withColumn("here", F.col("nearest").eqNullSafe(F.col("c.k")))
    kept = placed.filter("here OR ((nearest IS NULL OR nearest > c.k) AND 3 * get(d, cast(c.k AS int)) <= 3 * c.radius + n)")
    return kept.select(F.xxhash64("cell", "c.k").alias("cell"), "origin", "class", "root", "n", F.col("here").alias("home"))


def _sized(members: DataFrame) -> DataFrame:
    """With the region's size; regions without a member at home or with one component hold nothing to compare."""
    sizes = members.groupBy("cell").agg(F.count("*").alias("size"), F.max("home").alias("any"), F.min("root").alias("low"), F.max("root").alias("high")).filter("any AND low <> high")
    return members.join(sizes.select("cell", "size"), "cell")


def pairs_across(named: DataFrame, kinds: DataFrame, whole: bool) -> DataFrame:
    """Pairs (a, b) of one region and different components that sizes and bitmaps allow. named: region, class, n, root.

    With whole=False also rows `again`: regions that have more pairs than were given (see Members.pairs).
    """
    rows = named.select(F.col("region").alias("cell"), F.col("region").alias("origin"), "class", "root", "n", F.lit(True).alias("home"))
    current, done = persisted(_sized(rows), "cells"), []
    total = current.count()
    for level in range(LEVELS):
        done.append(current.filter(F.col("size") <= LARGE))
        large = current.filter(F.col("size") > LARGE)
        if large.isEmpty():
            break
        current = persisted(_sized(divided(large, kinds, level)), "cells")
    else:
        done.append(current)
    parts = done[0]
    for part in done[1:]:
        parts = parts.unionByName(part)
    blocks = F.ceil(F.col("size") / LARGE).cast("int")
    dealt = parts.withColumn("block", F.pmod(F.hash("class"), blocks)).withColumn("small", F.col("size") <= SMALL)
    meet = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    dealt = dealt.select("*", F.explode(meet).alias("m")).select(*CELLS, "block", "small", "m.i", "m.j").join(kinds.select("class", "parities"), "class")
    # small regions go together in groups of bounded size, each larger one (or each pair of its blocks) is a group of its own
    packs = max(16, total // PACKED)
    keys = [F.when(F.col("small"), F.pmod(F.xxhash64("cell"), F.lit(packs))).alias("pack"), *[F.when(~F.col("small"), F.col(c)).alias(f"own_{c}") for c in ("cell", "i", "j")]]

    def compare(group: pa.Table) -> pa.Table:
        small = group.column("small")[0].as_py()
        if small:
            group = group.sort_by([("cell", "ascending"), ("class", "ascending")])
        cls, root, n, block, cell = (group.column(c).to_numpy() for c in ("class", "root", "n", "block", "cell" if small else "origin"))
        home, bits = group.column("home").to_numpy(zero_copy_only=False).astype(bool), _table_of_bits(group.column("parities"))
        cross = not small and group.column("i")[0].as_py() != group.column("j")[0].as_py()
        a, b, more = Members(cls, root, n, home, bits, block if cross else None, cell).pairs(small, whole)
        if small and len(more):  # regions are named by their first-level region
            more = group.column("origin").to_numpy()[np.searchsorted(cell, more)]
        gap = lambda count: np.zeros(count, bool)
        return pa.table(
            [
                pa.array(np.concatenate([a, np.zeros(len(more), np.int64)]), pa.int64(), mask=np.concatenate([gap(len(a)), ~gap(len(more))])),
                pa.array(np.concatenate([b, np.zeros(len(more), np.int64)]), pa.int64(), mask=np.concatenate([gap(len(a)), ~gap(len(more))])),
                pa.array(np.concatenate([np.zeros(len(a), np.int64), more]), pa.int64(), mask=np.concatenate([~gap(len(a)), gap(len(more))])),
            ],
            names=["a", "b", "again"],
        )

    return dealt.select("*", *keys).groupBy("pack", "own_cell", "own_i", "own_j").applyInArrow(compare, "a long, b long, again long")


# --- exact decisions -------------------------------------------------------------------------------------------------------


class Sets:
    """Shingle sets of classes, computed from the text of one document each when they are first asked for."""

    def __init__(self, docs: DataFrame, described: DataFrame):
        self.docs, self.known, self.spark = docs, None, docs.sparkSession
        self.sources = described.filter("n > 0").groupBy("class").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "key")).alias("s")).select("class", "s.*")

    def fetch(self, classes: DataFrame) -> DataFrame:
        """class, codes of the classes (and of some more)."""
        missing = classes if self.known is None else classes.join(self.known.select("class"), "class", "left_anti")
        # the driver holds one bit per slot, whatever their number; documents in other slots are not read further
        slot = F.col("doc_id").bitwiseXOR(F.col("key")).bitwiseAND((1 << FILTER_BITS) - 1) + 1  # the bitmap functions number from 1
        wanted = self.sources.join(missing, "class", "left_semi")
        maps = wanted.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
        if maps or self.known is None:
            gate = np.zeros(1 << FILTER_BITS, bool)
            for row in maps:
                bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
                gate[(row.part - 1) * len(bits) + np.flatnonzero(bits)] = True
            found = persisted(self._computed(np.packbits(gate)), "sets")
            self.known = found if self.known is None else self.known.unionByName(found.join(self.known.select("class"), "class", "left_anti"))
        return self.known

    def _computed(self, gate: np.ndarray) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(gate)

        def emit(batches):
            gate, fresh = shared.value, _Fresh()
            for batch in batches:
                slot = (batch.column("doc_id").fill_null(0).to_numpy() ^ batch.column("key").to_numpy()) & ((1 << FILTER_BITS) - 1)
                open_slot = (gate[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
                for _, sizes, classes, _, codes in _sets(batch.column("text").filter(pa.array(open_slot.astype(bool)))):
                    stop, new = np.cumsum(sizes), fresh.of(classes)
                    rows = np.flatnonzero(new & (sizes > 0)).tolist()
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(classes[rows]), pa.array([codes[stop[i] - sizes[i] : stop[i]].tobytes() for i in rows], pa.binary())], names=["class", "codes"])

        return self.docs.mapInArrow(lean(emit), "class long, codes binary").dropDuplicates(["class"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) at distance 1/4 or less, by the exact intersection of their sets; the result is written to scratch."""
        sets = self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct())
        both = pairs.join(sets.select(F.col("class").alias("b"), F.col("codes").alias("y")), "b").join(sets.select(F.col("class").alias("a"), F.col("codes").alias("x")), "a")

        def judge(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                    common = _within(y, x).sum() if len(y) else 0
                    keep.append(bool(100 * common >= 75 * (len(x) + len(y) - common)))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return persisted(both.select("a", "b", "x", "y").mapInArrow(lean(judge), "a long, b long").distinct(), "links")


def class_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(described documents, class -> root for the classes that link with another)."""
    docs = id_and_text(docs).withColumn("key", F.xxhash64("text"))
    with arrow_batches(docs.sparkSession, ROWS, BYTES):
        return _class_components(docs)


def _class_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    described = persisted(describe(docs), "described")
    entries = described.filter("shingle IS NULL").agg(F.sum("n")).first()[0] or 0
    members = persisted(regions(docs, _order(described), entries // 4), "regions")
    kinds = persisted(described.filter("shingle IS NULL").join(members.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("parities").alias("parities")), "kinds")
    sets, roots, edges, tried = Sets(docs, described), None, None, None

    def grown(pairs: DataFrame):
        """Decides the pairs that have not been yet, and joins components."""
        nonlocal roots, edges, tried
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = persisted(_possible(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), kinds), "pairs")
        links = sets.links(fresh)
        tried = fresh if tried is None else tried.unionByName(fresh)
        if roots is None or not links.isEmpty():
            edges = links if edges is None else edges.unionByName(links)
            roots = persisted(connected_components(edges), "roots")

    def mixed() -> DataFrame:
        """Members of the regions that hold several components."""
        named = members.join(roots.withColumnRenamed("id", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        several = named.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("region")
        return persisted(named.join(several, "region", "left_semi"), "mixed")

    pivot = members.groupBy("region").agg(F.min(F.struct("class", "n")).alias("p"))
    grown(members.join(pivot, "region").filter("4 * least(n, p.n) >= 3 * greatest(n, p.n)").select(F.col("class").alias("a"), F.col("p.class").alias("b")))
    found = persisted(pairs_across(mixed(), kinds, whole=False), "found")
    grown(found.filter("a IS NOT NULL").select("a", "b"))
    again = found.filter("again IS NOT NULL").select(F.col("again").alias("region")).distinct()
    if not again.isEmpty():
        grown(pairs_across(mixed().join(again, "region", "left_semi"), kinds, whole=True).select("a", "b"))
    return described, roots


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    described, roots = class_components(docs)
    rows = described.filter("shingle IS NULL").select("doc_id", "n", "class").join(roots.withColumnRenamed("id", "class"), "class", "left")
    rows = rows.withColumn("root", F.coalesce("root", "class"))
    least = rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = rows.join(least, "root", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest doc_id, null last, and of its texts one.

    It is decided by row (doc_id and text), so rows of one doc_id, null too, that are in different components do not touch each
    other. Rows without shingles link with nothing and stay. Of rows that repeat doc_id and text one stays.
    """
    described, roots = class_components(docs)
    rows = described.filter("shingle IS NULL").select("doc_id", "n", "class", "key").join(roots.withColumnRenamed("id", "class"), "class", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "class", "key")
    chosen = rows.filter("n > 0").groupBy(F.coalesce("root", "class")).agg(F.min(order).alias("c")).select("c.doc_id", "c.key")
    stays = chosen.union(rows.filter("n = 0").select("doc_id", "key")).distinct()
    whole = docs.select(F.struct("*").alias("row"))  # columns of docs can't clash with ours
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("key"))
    kept = whole.join(stays, same, "left_semi")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).dropDuplicates(["doc_id", "text"])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
