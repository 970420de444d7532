"""Quality classifier: a linear SVM on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators of a text: n-grams (1 to 4) of its bytes after mapping letters to their case and digits to one digit, hashed; n-grams
(2, 3) of its raw bytes, hashed; and how often words repeat at distances 1 to 3 and lines repeat, in steps. Each indicator is
scaled by the log ratio of its smoothed counts in the two classes, and the hinge loss is minimised by dual coordinate descent.
Platt scaling on rows held back from the fit turns margins into probabilities.

The fit uses at most `max_rows` labelled rows (the documented bound), chosen by hash; scoring runs over all rows in place, without
a shuffle. Null text counts as empty; null doc_id or null labels are never learnt from; several labels of one doc_id count as the
largest, and of several texts one is learnt from; repeated rows are scored each; without labels of both classes every score is 0.5; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import BASE, id_and_text, lean, small_batches, table

BITS = 18
#: Classes of bytes: lower-case and non-ASCII letters, capitals, digits, line ends, other white space; other bytes stand for themselves.
LOWER, UPPER, DIGIT, LINE, SPACE = 97, 65, 48, 10, 32
#: Shares at which a repetition indicator is set.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64)
    out[128:] = LOWER
    for first, last, to in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
        out[ord(first) : ord(last) + 1] = to
    out[[9, 11, 12, 13]] = SPACE
    return out


CLASSES = _classes()


class Indicators:
    """Sorted distinct indicator numbers (below 2**BITS + 64) of a text."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, bool)

    def _grams(self, units: np.ndarray, sizes: tuple[int, ...], seed: int) -> list[np.ndarray]:
        out, code = [], np.zeros(len(units), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, max(sizes) + 1):
                if len(units) < n:
                    break
                code = code[: len(units) - n + 1] * np.uint64(257) + units[n - 1 :] + np.uint64(1)
                if n in sizes:
                    out.append(((code + np.uint64(seed + n)) * BASE >> np.uint64(64 - BITS)).astype(np.int64))
        return out

    def of(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        for codes in self._grams(CLASSES[raw], (1, 2, 3, 4), 1000) + self._grams(raw.astype(np.uint64), (2, 3), 2000):
            self.seen[codes] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        words, lines, extra = text.split(), text.split("\n"), []
        shares = [sum(map(eq, words, words[k:])) / max(1, len(words) - k) for k in (1, 2, 3)] + [1 - len(set(lines)) / len(lines)]
        for kind, share in enumerate(shares):
            extra += [(1 << BITS) + kind * len(STEPS) + i for i, step in enumerate(STEPS) if share >= step]
        return np.concatenate([found, np.array(extra, np.int64)])


@dataclass
class Model:
    """weights: per indicator, already scaled; probability = 1 / (1 + exp(slope * margin + shift))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = (self.weights[found].sum() + self.bias) if len(found) else self.bias
        return float(1 / (1 + np.exp(np.clip(self.slope * margin + self.shift, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    counts = [smooth + np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == sign] or [np.zeros(0, np.int64)]), minlength=size) for sign in (1, -1)]
    n = [smooth + (y == sign).sum() for sign in (1, -1)]
    return np.log(counts[0] / n[0]) - np.log(counts[1] / n[1])


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum c_i max(0, 1 - y_i (w x_i + b)); x_i has values[j] at each j of rows[i], and 1 for the bias."""
    w, b, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    norms = np.array([(values[r] ** 2).sum() + 1 for r in rows])
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        moved = 0.0
        for i in order:
            r = rows[i]
            gradient = y[i] * (w[r] @ values[r] + b) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), c[i])
            if step := new - alpha[i]:
                w[r] += step * y[i] * values[r]
                b += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step) * norms[i])
        if moved < 1e-3:
            break
    return w, b


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift of P(1) = 1 / (1 + exp(slope * margin + shift)), by Newton's method on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 0.0, np.log((down + 1) / (up + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(a * margins + b, -30, 30)))
        d, h = target - p, p * (1 - p)
        g = np.array([(d * margins).sum(), d.sum()])
        hess = np.array([[(h * margins**2).sum(), (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.1) -> Model | None:
    """labels: 0 or 1. One row in five of each class calibrates, the others fit; where a class has fewer than five rows, all rows do both. None if a class is missing."""
    y, size = np.where(np.asarray(labels) > 0, 1, -1), (1 << BITS) + 64
    if len(rows) == 0 or y.min() == y.max():
        return None
    nth = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y < 0))
    held = nth % 5 == 0
    fitting, calibrating = (~held, held) if min((y > 0).sum(), (y < 0).sum()) >= 5 else (np.ones(len(y), bool),) * 2
    part = lambda mask: [r for r, m in zip(rows, mask, strict=True) if m]
    ratios = log_count_ratios(part(fitting), y[fitting], size)
    rare = len(y) / (2.0 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, b = dual_coordinate_descent(part(fitting), ratios, y[fitting], cost * rare[fitting])
    weights = w * ratios
    margins = np.array([weights[r].sum() + b for r in part(calibrating)])
    return Model(weights.astype(np.float32), b, *platt(margins, y[calibrating]))


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def one_text_each(sample: DataFrame) -> DataFrame:
    """doc_id, text, label with one row a doc_id, though doc_ids repeat: of several texts the one with the smallest hash."""
    least = sample.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x"))
    return least.select("doc_id", "x.text", "label")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> Model | None:
    """Fit on at most `max_rows` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna().filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def describe(batches):
        indicators = Indicators()
        for batch in batches:
            rows = [indicators.of(t.as_py()).astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "found"])

    sample = one_text_each(docs.join(F.broadcast(chosen), "doc_id")).mapInArrow(lean(describe), "doc_id long, label int, found binary")
    got = sample.toArrow().sort_by("doc_id")
    rows, y = [np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in got["found"]], got["label"].to_pylist()
    return fit(rows, np.array(y))


def quality_scores(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        indicators, model = Indicators(), shared.value
        for batch in batches:
            scores = np.array([0.5 if model is None else model.score(indicators.of(t.as_py())) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(score), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least `threshold`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        indicators, model = Indicators(), shared.value
        for batch in batches:
            yield batch.filter(pa.array([model is None or model.score(indicators.of(t.as_py() or "")) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
