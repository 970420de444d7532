"""Link paths, marks, releases and pointers: brute force, odd rows, and runs that die between two steps."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from heronry.operators import paths, retention
from heronry.scratch import scratch_path
from heronry.sinks import release
from heronry.sources import pinned


def breadth_first(starts, links):
    """Paths as a queue finds them: starting points by rank, links in their order."""
    found = {}
    for page in {p for p, _, _ in starts}:
        queue, way = deque(), {}
        for _, i, _ in sorted((s for s in starts if s[0] == page), key=lambda s: s[2]):
            if i not in way:
                way[i] = []
                queue.append(i)
        while queue:
            at = queue.popleft()
            for a, b in sorted(links):
                for x, y in ((a, b), (b, a)):
                    if x == at and y not in way:
                        way[y] = way[at] + [(a, b, y)]
                        queue.append(y)
        found |= {(page, i): w for i, w in way.items()}
    return found


@pytest.mark.parametrize("seed", range(3))
def test_paths_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    links = {tuple(sorted(rng.sample(range(24), 2))) for _ in range(30)} | {(30, 31), (31, 32), (30, 32)}
    starts = [("p", 0, 0), ("p", 5, 1), ("q", 5, 0), ("r", 31, 0), ("r", 99, 1)]
    rows = paths.shortest_paths(spark.createDataFrame(starts + starts[:1], "page string, id long, rank long"), spark.createDataFrame(list(links) * 2 + [(None, 3), (7, 7)], "a long, b long")).collect()
    assert {(r.page, r.id): [tuple(s) for s in r.path] for r in rows} == breadth_first(starts, links)
    assert all(r.depth == len(r.path) for r in rows)


def test_paths_of_nothing(spark):
    links, starts = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([("p", 1, 0), (None, 2, 0), ("p", None, 0)], "page string, id long, rank long")
    assert [(r.page, r.id, r.depth) for r in paths.shortest_paths(starts, links).collect()] == [("p", 1, 0)]
    assert paths.shortest_paths(starts.limit(0), links).count() == 0


def test_marks_go_through_cycles_and_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0), (50, 51), (3, None), (3, 4)], "from long, to long")
    marks = retention.reachable(spark.createDataFrame([(0,), (None,), (60,)], "id long"), edges)
    assert sorted(r.id for r in marks.collect()) == [*range(13), 60]
    pool = spark.createDataFrame([(5, "2024-01-01"), (51, "2024-01-01"), (52, "2024-01-09 12:00:00"), (53, None), (54, "2024-01-08 00:00:00")], "id long, uploaded string").withColumn("uploaded", F.col("uploaded").cast("timestamp"))
    assert [r.id for r in retention.sweepable(pool, marks, F.lit("2024-01-10").cast("timestamp")).collect()] == [51]


def test_floor_and_untimed_sets(spark):
    sets = spark.createDataFrame([("set-20240101T000000Z",), ("set-20230101T000000Z",), ("set-20220101T000000Z",), ("set-20210101T000000Z",), ("first",)], "set_id string")
    none = spark.createDataFrame([("feed-20210101T000000Z",)], "release string")
    kept = {r.set_id: r.reason for r in retention.retained_sets(sets, none, F.lit("2024-06-01").cast("timestamp")).collect()}
    assert kept == {"set-20240101T000000Z": "floor", "set-20230101T000000Z": "floor", "set-20210101T000000Z": "pinned", "first": "untimed"}
    with pytest.raises(ValueError):
        retention.retained_sets(sets, none, F.lit("2024-06-01").cast("timestamp"), floor=1)


class _Dies:
    """The file system, but for the rename of a pointer, where the writer dies."""

    def __init__(self, files):
        self.files = files

    def __getattr__(self, name):
        if name == "rename":
            raise InterruptedError("the writer died")
        return getattr(self.files, name)


def test_a_writer_that_dies_leaves_the_pointer(spark, monkeypatch):
    path = scratch_path(spark, "pointer")
    assert release.read_pointer(spark, path) is None
    assert release.switch_pointer(spark, path, {"release": "r1"}) and not release.switch_pointer(spark, path, {"release": "r1"})
    file = release._file
    monkeypatch.setattr(release, "_file", lambda s, p: (_Dies(file(s, p)[0]), file(s, p)[1]))
    with pytest.raises(InterruptedError):
        release.switch_pointer(spark, path, {"release": "r2"})
    monkeypatch.setattr(release, "_file", file)
    assert release.read_pointer(spark, path) == {"release": "r1"}
    for k in range(2, 6):
        assert release.switch_pointer(spark, path, {"release": f"r{k}"})
    assert release.read_pointer(spark, path) == {"release": "r5"} and len(release._pointer_files(spark, path)) == 2


def test_months_go_on_after_a_run_that_died(spark):
    path = scratch_path(spark, "months")
    rows = spark.createDataFrame([("2024-01", 1, 1.0, 0), ("2024-02", 2, 2.0, 0)], "month string, id int, value double, revision int")
    rows.filter("id = 1").write.partitionBy("month").parquet(f"{path}/data/version=0")  # died before versions were written
    assert release.read_months(spark, path) is None
    for _ in range(2):
        release.upsert_months(spark, rows, path, ["id"], ["revision"])
        assert sorted((r.month, r.id) for r in release.read_months(spark, path).collect()) == [("2024-01", 1), ("2024-02", 2)]


def test_a_pinned_release_stays_whole(spark):
    root = scratch_path(spark, "pinned")
    with pytest.raises(FileNotFoundError):
        pinned.pin(spark, root)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, body string")
    pinned.publish_details(rows, "id", root, "a")
    held = pinned.pin(spark, root)
    pinned.publish_details(rows.filter("id < 3").withColumn("body", F.lit("new")), "id", root, "b")
    assert held.details(spark).count() == 50 and held.manifest(spark).count() == 50
    few = spark.createDataFrame([(7,), (8,), (99,), (7,)], "id long")
    for listed in (10, 1):
        assert sorted((r.id, r.body) for r in held.details(spark, few, "id", listed).collect()) == [(7, "t7"), (8, "t8")]
    assert {r.body for r in pinned.pin(spark, root).details(spark).collect()} == {"new"}
