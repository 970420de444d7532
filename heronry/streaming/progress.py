"""State that outlives its rows: what has been done, failed or missed for each key with retries on a timer, and a breaker that latches.

Both are processors for transformWithState. A row that a key has seen, by (at, number), changes nothing, so replayed files leave the
state alone; rows of one key are taken in that order within a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hours until a first retry, doubled with each failure in a row, at most a month (fixed values).
FIRST_PAUSE, LONGEST_PAUSE = 24, 720
HOUR_MS = 3_600_000

PROGRESS = "key long, status string, mark string, failures int, attempts long, absent_us long, retry_ms long, due boolean"


def followed(state: tuple, rows: pd.DataFrame) -> tuple:
    """The state (see Progress) after one key's rows of a batch, in the order of (at, number); those at or before the last one are known.

    Only what comes after the last success or removal counts, so the rows are read as columns and never one by one.
    """
    _, mark, failures, attempts, absent, _, last_at, last_number = state
    at, number = rows.at_us.to_numpy("int64"), rows.number.to_numpy("int64")
    order = np.lexsort((number, at))
    at, number = at[order], number[order]
    fresh = (at > last_at) | ((at == last_at) & (number > last_number))
    fresh[1:] &= (at[1:] != at[:-1]) | (number[1:] != number[:-1])
    if not fresh.any():
        return state
    at, number, order = at[fresh], number[fresh], order[fresh]
    outcome = rows.outcome.to_numpy(object)[order]
    failed, missed = outcome == "failed", outcome == "absent"
    ends = np.flatnonzero(~(failed | missed))
    after = 0
    if len(ends):
        after, failures, absent = ends[-1] + 1, 0, None
        mark = rows.mark.iloc[order[ends[-1]]] if outcome[ends[-1]] == "done" else None
    misses = np.flatnonzero(missed[after:])
    if absent is None and len(misses):
        absent = int(at[after + misses[0]])
    failures += int(failed[after:].sum())
    status = outcome[-1] if outcome[-1] in ("done", "failed", "absent") else "forgotten"
    # Beyond ten doublings the pause is the longest.
    retry = int(at[-1]) // 1000 + min(FIRST_PAUSE * 2 ** min(failures - 1, 10), LONGEST_PAUSE) * HOUR_MS if status == "failed" else None
    return (status, mark, failures, attempts + len(at), absent, retry, int(at[-1]), int(number[-1]))


class Progress(StatefulProcessor):
    """Per key: the last outcome (done, failed, absent or forgotten), the mark of what was done, failures in a row, attempts (each call
    counts, whatever its outcome), since when it is absent, and when it may be tried again. A row tells `due` when that time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "status string, mark string, failures int, attempts long, absent_us long, retry_ms long, at_us long, number long")

    def _row(self, key, state, due: bool) -> pd.DataFrame:
        status, mark, failures, attempts, absent, retry, _, _ = state
        whole = lambda x: pd.array([x], dtype="Int64")
        return pd.DataFrame({"key": [key[0]], "status": [status], "mark": [mark], "failures": [failures], "attempts": [attempts], "absent_us": whole(absent), "retry_ms": whole(retry), "due": [due]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() or ("new", None, 0, 0, None, None, -1, -1)
        state = followed(tuple(before), pd.concat(list(rows)))
        if state == tuple(before):
            return
        if before[5] is not None:
            self.handle.deleteTimer(before[5])
        if state[5] is not None:
            self.handle.registerTimer(state[5])
        self.state.update(state)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, self.state.get(), True)

    def close(self) -> None:
        pass


BREAKER = "scope string, tripped boolean, metric string, value double, threshold double, opened_us long, metrics string"


class Breaker(StatefulProcessor):
    """Per scope: closed until a metric reaches its threshold; the first to do so (a spike before the budget) is the reason. An open
    breaker only gains metrics that trip later, and no row closes it; a missing value trips nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "metric string, value double, threshold double, opened_us long, metrics string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        fresh = pd.concat(list(rows))
        over = fresh[fresh.value >= fresh.threshold].assign(order=lambda x: (x.metric != "spike").astype(int)).sort_values(["at_us", "order", "metric"])
        before = state
        for at, metric, value, threshold in zip(over.at_us, over.metric, over.value, over.threshold, strict=True):
            if state is None:
                state = (metric, float(value), float(threshold), int(at), metric)
            elif metric not in state[4].split(","):
                state = (*state[:4], f"{state[4]},{metric}")
        if state is None or (before is not None and tuple(before) == tuple(state)):
            return
        self.state.update(tuple(state))
        yield pd.DataFrame([(key[0], True, *state)], columns=["scope", "tripped", "metric", "value", "threshold", "opened_us", "metrics"])

    def close(self) -> None:
        pass


def _kept(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, target: str, checkpoint: str, partitions: int | None) -> None:
    spark = rows.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        told = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode=mode)

        def write(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

        told.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def track(attempts: DataFrame, target: str, checkpoint: str, late: str = "0 seconds", partitions: int | None = None) -> None:
    """attempts: a stream of key, at, at_us, number, outcome, mark. Every change of a key's progress is written to target.

    partitions: of the state, fixed at a checkpoint's first run; the session's shuffle partitions where none are named."""
    _kept(attempts.withWatermark("at", late), "key", Progress(), PROGRESS, "EventTime", target, checkpoint, partitions)


def guard(measured: DataFrame, target: str, checkpoint: str, partitions: int | None = None) -> None:
    """measured: a stream of scope, at_us, metric, value, threshold. Every change of a scope's breaker is written to target."""
    _kept(measured, "scope", Breaker(), BREAKER, "None", target, checkpoint, partitions)


def changes(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All rows that track or guard have written, with the batch they came in."""
    return spark.read.schema(f"{schema}, batch int").parquet(target)
