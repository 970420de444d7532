"""The weekly digest: a run that stops between stages, and inputs that are empty or odd."""

import pytest
from pyspark.sql import functions as F

from heronry.operators import digest as D
from heronry.plans.weekly import END, RULES, _inputs
from heronry.scratch import scratch_path


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return _inputs(spark, sf_dir)


def run(spark, folder, inputs):
    return sorted(tuple(r) for r in D.digest(spark, folder, *inputs, F.lit(END).cast("timestamp"), RULES).collect())


def test_a_run_goes_on_after_it_stopped(spark, inputs, monkeypatch):
    whole = run(spark, scratch_path(spark, "digest"), inputs)
    folder = scratch_path(spark, "digest")
    monkeypatch.setattr(D, "checked", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, folder, inputs)
    monkeypatch.undo()
    for stage in ("candidates", "placed", "cards"):  # these stages were finished: they are read, not made again
        monkeypatch.setattr(D, stage, lambda *_: 1 / 0)
    assert run(spark, folder, inputs) == whole and len(whole) > 20


def test_an_empty_week(spark, inputs):
    records, *rest = inputs
    assert [r for r in run(spark, scratch_path(spark, "digest"), (records.limit(0), *rest)) if r[0] not in ("rejected",)] == []


def test_sentences_and_their_reasons(spark):
    threads = spark.createDataFrame([("a", "x [ANNOUNCE] y", "merged"), ("b", None, None)], "thread string, title string, status string")
    given = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b")], "place string, thread string")
    rows = [("Fixed and released.", ["b", "a"]), ("Fixed", ["b"]), ("unfixed things", ["b"]), ("", ["a"]), (None, ["a"]), ("x", None), ("x", ["a", "z"]), ("they PUSHED\tback", ["a"]), ("y" * 241, ["a"]), ("accepted", ["a", "a"])]
    sentences = spark.createDataFrame([("c", i, s, c) for i, (s, c) in enumerate(rows)], "place string, position int, sentence string, cites array<string>")
    told = {r.position: r.reason for r in D.checked(sentences, threads, given).collect()}
    assert [told[i] for i in range(len(rows))] == [None, "status:fixed", None, "length", "length", "no-cites", "cite-outside-inputs", "stance:pushed back", "length", None]
