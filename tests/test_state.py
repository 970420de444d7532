"""Polls by cursor, keyed state with timers, the latched breaker and hooks, on small streams."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from heronry.scratch import scratch_path
from heronry.sources import cursor
from heronry.streaming import hooks, progress, publication, tables

MINUTE = 60_000_000


def listing(spark, path, rows):
    spark.createDataFrame(rows, "id long, updated_us long, body string").coalesce(1).write.mode("append").parquet(path)


def test_a_poll_takes_ties_whole_and_reads_the_overlap_again(spark, tmp_path):
    path = str(tmp_path / "listing")
    listing(spark, path, [(i, (i // 3) * 4 * MINUTE, "x") for i in range(12)])
    reader = cursor.CursorReader({"path": path, "since_us": -1, "most": 4, "splits": 3})
    seen, start = [], reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        windows = reader.partitions(start, end)
        seen.append(sorted(i for w in windows for b in reader.read(w) for i in b.column("id").to_pylist()))
        start = end
    # four items behind the cursor are taken, the fourth with all of its instant; the next window begins five minutes before
    assert seen == [[0, 1, 2, 3, 4, 5], [3, 4, 5, 6, 7, 8, 9, 10, 11]] or seen == [[0, 1, 2, 3, 4, 5], [*range(12)]]
    restarted = cursor.CursorReader({"path": path, "since_us": -1, "most": 4})
    restarted.partitions({"cursor": -1}, {"cursor": 4 * MINUTE})  # what Spark does with the checkpoint's last batch
    assert restarted.latestOffset() == {"cursor": 12 * MINUTE}
    with pytest.raises(ValueError):
        list(reader.read(cursor.Window(0, 4 * MINUTE, 7)))


def test_polls_find_what_arrives_late_within_the_overlap(spark):
    base = scratch_path(spark, "late")
    path = f"{base}/listing"
    listing(spark, path, [(1, 10 * MINUTE, "a"), (2, 20 * MINUTE, "b")])
    run = lambda: tables.append_checked(cursor.polled(spark, path, 0, 10), f"{base}/out", "id", f"{base}/progress")
    run()
    listing(spark, path, [(3, 17 * MINUTE, "late"), (4, 12 * MINUTE, "too late"), (5, 21 * MINUTE, "new")])
    run()
    assert sorted(r.id for r in tables.read_part(spark, f"{base}/out", "log", ["id"]).collect()) == [1, 2, 3, 5]


def attempts(spark, base, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "key long, at_us long, number long, outcome string, mark string").withColumn("at", F.timestamp_micros("at_us"))
        df.coalesce(1).write.parquet(f"{base}/in/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")


def test_a_failure_is_due_again_after_its_pause(spark):
    base, hour = scratch_path(spark, "due"), 60 * MINUTE
    first = hour  # rows at or below the watermark, at first the epoch, are late
    stream = attempts(spark, base, [[(1, first, 0, "failed", "a"), (2, first, 0, "failed", "b")], [(2, 2 * hour, 1, "done", "b2"), (1, first, 0, "failed", "a")], [(3, 30 * hour, 2, "absent", None)], [(3, 31 * hour, 3, "absent", None)]])
    progress.track(stream, f"{base}/out", f"{base}/checkpoint", "1 hour")
    rows = progress.changes(spark, f"{base}/out", progress.PROGRESS).orderBy("batch", "key").collect()
    last = {r.key: r for r in rows if not r.due}
    assert (last[1].status, last[1].failures, last[1].attempts, last[1].retry_ms) == ("failed", 1, 1, 25 * progress.HOUR_MS)
    assert (last[2].status, last[2].mark, last[2].failures, last[2].attempts) == ("done", "b2", 0, 2)
    assert (last[3].status, last[3].attempts, last[3].absent_us) == ("absent", 2, 30 * hour)
    assert [r.key for r in rows if r.due] == [1]  # the timer of 2 went when it was done


def test_an_open_breaker_only_gains_metrics(spark):
    base = scratch_path(spark, "breaker")
    batches = [[("s", 1, "budget", 1.0, 2.0), ("t", 1, "spike", None, 2.0)], [("s", 5, "budget", 3.0, 2.0), ("s", 5, "spike", 9.0, 8.0)], [("s", 6, "budget", 0.0, 2.0), ("s", 7, "budget", 9.0, 2.0)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "scope string, at_us long, metric string, value double, threshold double")
        df.coalesce(1).write.parquet(f"{base}/in/{i}")
    progress.guard(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*"), f"{base}/out", f"{base}/checkpoint")
    rows = progress.changes(spark, f"{base}/out", progress.BREAKER).collect()
    assert [(r.scope, r.metric, r.value, r.opened_us, r.metrics) for r in rows] == [("s", "spike", 9.0, 5, "spike,budget")]


@pytest.mark.parametrize(("hook", "outcome"), [(lambda status: time.sleep(3), "late"), (lambda status: 1 / 0, "failed: ZeroDivisionError"), (None, "none"), (lambda status: None, "ok")])
def test_a_hook_never_fails_the_stream(spark, hook, outcome):
    base = scratch_path(spark, "hook")
    for i in range(2):
        spark.range(i, i + 3).coalesce(1).write.parquet(f"{base}/in/{i}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    outcomes = hooks.run_with_hook(stream, f"{base}/out", f"{base}/checkpoint", f"q{base[-32:]}", hook, 0.3)
    assert outcomes == [(0, 3, outcome), (1, 3, outcome)]
    assert spark.read.parquet(f"{base}/out").count() == 6


def test_a_batch_that_was_not_published_runs_again(spark, monkeypatch):
    base = scratch_path(spark, "publication")
    for i in range(2):
        spark.range(i * 3, i * 3 + 3).coalesce(1).write.parquet(f"{base}/in/{i}")
    counted = lambda log: log.groupBy((F.col("id") % 2).alias("k")).agg(F.count("*").alias("n"))
    run = lambda: publication.publish_batches(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*"), base, "k", f"{base}/progress", counted)
    real, calls = publication.R.publish, []

    def dies(*args, **more):
        calls.append(args[2])
        if calls == ["r0", "r1"]:
            raise InterruptedError("after the append, before the pointer")
        return real(*args, **more)

    monkeypatch.setattr(publication.R, "publish", dies)
    with pytest.raises(Exception, match="before the pointer"):
        run()
    assert sorted(map(tuple, publication.published(spark, base).collect())) == [(0, 2), (1, 1)]
    run()
    assert calls == ["r0", "r1", "r1"] and sorted(map(tuple, publication.published(spark, base).collect())) == [(0, 3), (1, 3)]


def one_by_one(state, rows):
    """The rule of Progress, a row at a time."""
    for at, number, outcome, mark in sorted(rows, key=lambda r: r[:2]):
        _, kept, failures, attempts, absent, _, *last = state
        if (at, number) > tuple(last):
            if outcome in ("done", "forgotten"):
                state = (outcome, mark if outcome == "done" else None, 0, attempts + 1, None, None, at, number)
            elif outcome == "absent":
                state = ("absent", kept, failures, attempts + 1, at if absent is None else absent, None, at, number)
            else:
                state = ("failed", kept, failures + 1, attempts + 1, absent, at // 1000 + min(24 * 2**failures, 720) * progress.HOUR_MS, at, number)
    return state


def test_rows_of_a_batch_give_what_they_give_one_by_one():
    draw = random.Random(3)
    for _ in range(300):
        rows = [(draw.randrange(8), draw.randrange(3), draw.choice(["failed", "failed", "absent", "absent", "done", "forgotten"]), draw.choice(["a", "b", None])) for _ in range(draw.randrange(1, 16))]
        frame = lambda x: pd.DataFrame(x, columns=["at_us", "number", "outcome", "mark"])
        whole = single = ("new", None, 0, 0, None, None, -1, -1)
        for half in (rows[:7], rows[7:]):
            if half:
                whole = progress.followed(whole, frame(half))
                single = one_by_one(single, half)
        assert whole == single


def test_many_rows_of_one_key_take_no_loop():
    rows = pd.DataFrame({"at_us": range(500_000), "number": 0, "outcome": "failed", "mark": None})
    began = time.time()
    state = progress.followed(("done", "m", 0, 1, None, None, -1, -1), rows)
    assert state == ("failed", "m", 500_000, 500_001, None, 499 + 720 * progress.HOUR_MS, 499_999, 0) and time.time() - began < 5
