"""Toxicity: cumulative-link ordinal regression from sparse word features to an expected severity.

P(grade <= k) = logistic(threshold_k - w.x) with one weight vector w for all thresholds, thresholds kept in order by construction.
x holds log(1 + count) of words and of word beginnings (4 and 5 letters, for inflected forms); a proximal step after each gradient
step keeps w sparse, and only features with a weight are looked up when scoring.

The labels say toxic or not. Grades above 1 are set from the training rows alone: among toxic rows, the total count of the words
that mark toxic rows (highest smoothed log ratio) is cut at its terciles, giving grades 1 to 3; rows that aren't toxic have grade 0.

The fit uses at most `max_rows` labelled rows (the documented bound), chosen by hash. Scoring runs over all rows and whole texts in
place. Null text counts as empty; null doc_id or null labels are never learnt from; several labels of one doc_id count as the
largest, and of several texts one is learnt from; repeated rows are scored each; without labels of both classes severity and score are 0; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm.common import id_and_text, lean, small_batches, table
from heronry.llm.quality import one_text_each

WORD = re.compile(r"[^\W\d_]+")
GRADES = 3
SCHEMA = "doc_id long, score double, expected_severity double, grade int, predicted int"


def features(words: dict[str, int]) -> Counter:
    """Counts of words and, marked by a caret, of the beginnings of longer words."""
    out = Counter(words)
    for word, n in words.items():
        for size in (4, 5):
            if len(word) > size:
                out["^" + word[:size]] += n
    return out


@dataclass
class Severity:
    weights: dict[str, float]
    thresholds: np.ndarray

    def __post_init__(self):
        self.starts = {w.lstrip("^")[:4] for w in self.weights}

    def exceed(self, text: str) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 1."""
        starts = self.starts
        words = Counter([w for w in WORD.findall(text.lower()) if w[:4] in starts])
        counts = {w: n for w, n in features(words).items() if w in self.weights}
        eta = sum(self.weights[w] * np.log1p(n) for w, n in counts.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - eta, -30, 30)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_cumulative_link(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, penalty: float = 2e-4, steps: int = 400, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """rows: (word numbers, values). Adam steps on the mean likelihood, with soft thresholding of the weights."""
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    words, values = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0) for k in (0, 1))
    words = words.astype(np.int64)
    top = grades.max()
    w, theta = np.zeros(size), np.array([np.log(max((grades <= k).mean(), 1e-3) / max((grades > k).mean(), 1e-3)) for k in range(top)])
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    first, second = np.zeros(size + top), np.zeros(size + top)
    for t in range(1, steps + 1):
        theta = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
        eta = np.bincount(owner, w[words] * values, minlength=len(rows))
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(edge[grades + 1] - eta), sigmoid(edge[grades] - eta)
        hi[grades == top], lo[grades == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_eta = (d_hi - d_lo) / len(rows)  # of the negative log likelihood
        g_w = np.bincount(words, g_eta[owner] * values, minlength=size)
        g_theta = np.zeros(top)
        np.add.at(g_theta, np.minimum(grades, top - 1), np.where(grades < top, -d_hi, 0) / len(rows))
        np.add.at(g_theta, np.maximum(grades - 1, 0), np.where(grades > 0, d_lo, 0) / len(rows))
        g_free = np.array([g_theta.sum()] + [g_theta[k:].sum() * np.exp(free[k]) for k in range(1, top)])
        g = np.concatenate([g_w, g_free])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-4)
        w -= move[:size]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty / (np.sqrt(second[:size] / (1 - 0.99**t)) + 1e-4), 0)
        free = free - 0.2 * move[size:]
    return w, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def fit(counts: list[dict[str, int]], toxic: np.ndarray, least_df: int = 3) -> Severity | None:
    """counts: features of each row; toxic: 0 or 1."""
    if len(counts) == 0 or toxic.min() == toxic.max():
        return None
    df, df_toxic = Counter(), Counter()
    for c, t in zip(counts, toxic, strict=True):
        df.update(c.keys())
        if t:
            df_toxic.update(c.keys())
    n, n_toxic = len(counts), int(toxic.sum())
    ratio = {w: np.log((df_toxic[w] + 0.5) / (n_toxic + 1)) - np.log((d - df_toxic[w] + 0.5) / (n - n_toxic + 1)) for w, d in df.items() if d >= least_df}
    vocabulary = {w: i for i, w in enumerate(sorted(ratio))}
    if not vocabulary:
        return None
    floor = max(3, 0.03 * n_toxic)
    markers = {w for w, r in ratio.items() if r > 1.5 and df_toxic[w] >= floor}
    hits = np.array([sum(k for w, k in c.items() if w in markers) for c in counts], float)
    grades = np.zeros(n, int)
    cuts = np.quantile(hits[toxic > 0], [1 / 3, 2 / 3])
    grades[toxic > 0] = 1 + (hits[toxic > 0][:, None] > cuts[None, :]).sum(axis=1)
    while GRADES and len(np.unique(grades)) < grades.max() + 1:  # ties may leave a grade empty: close the gap
        present = np.unique(grades)
        grades = np.searchsorted(present, grades)
    rows = [(np.array([vocabulary[w] for w in c if w in vocabulary]), np.log1p(np.array([k for w, k in c.items() if w in vocabulary], float))) for c in counts]
    w, theta = fit_cumulative_link(rows, grades, len(vocabulary))
    return Severity({word: float(w[i]) for word, i in vocabulary.items() if abs(w[i]) > 0.05}, theta)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Severity | None:
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def describe(batches):
        for batch in batches:
            rows = [json.dumps(Counter(WORD.findall(t.as_py().lower())), ensure_ascii=False) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.string())], names=["doc_id", "label", "counts"])

    sample = one_text_each(docs.join(F.broadcast(chosen), "doc_id")).mapInArrow(lean(describe), "doc_id long, label int, counts string")
    got = sample.toArrow().sort_by("doc_id")
    # only features of two sampled rows at least can enter the vocabulary; the others are let go row by row
    seen, often = set(), set()
    for c in got["counts"]:
        words = features(json.loads(c.as_py())).keys()
        often.update(w for w in words if w in seen)
        seen.update(words)
    counts = [{w: n for w, n in features(json.loads(c.as_py())).items() if w in often} for c in got["counts"]]
    toxic = got["label"].to_pylist()
    return fit(counts, np.array(toxic))


def severities(docs: DataFrame, model: Severity | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score = P(grade >= 1), expected severity, likeliest grade and predicted (score >= threshold) for every row."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            exceed = [np.zeros(GRADES) if model is None else model.exceed(t.as_py()) for t in batch.column("text")]
            p = [np.concatenate([[1.0], e, [0.0]]) for e in exceed]
            any_grade = np.array([e[0] for e in exceed])
            columns = [batch.column("doc_id"), pa.array(any_grade, pa.float64()), pa.array([float(e.sum()) for e in exceed], pa.float64()), pa.array([int(np.argmax(x[:-1] - x[1:])) for x in p], pa.int32()), pa.array((any_grade >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "expected_severity", "grade", "predicted"])

    return docs.mapInArrow(lean(score), SCHEMA)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severities(docs, train(docs, table(spark, sf_dir, "labels")))
