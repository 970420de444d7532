"""The whole pipeline over odd documents: null and very long texts, ties, repeated rows, columns of clashing names, and an empty table."""

from collections import Counter

import corpus_pipeline
from heronry.scratch import persisted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, places string, kept boolean, chunk long"
STEADY = "Sober prose that a reader may follow without effort, one sentence after another, until the matter is told. "


def rows(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40).collect()
    texts = [(r.doc_id, r.text) for r in known]
    texts += [(9001, None), (9002, ""), (9003, STEADY), (9003, STEADY), (9004, "word " * 60_000), (None, STEADY + "Without a number."), (None, None), (9005, "\n\n\n"), (9006, STEADY.upper())]
    return [(i, t, "en", "s", len(t or ""), 1, "clash", True, 7) for i, t in texts]


def through(spark, sf_dir, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = persisted(stage(spark, docs, sf_dir), f"odd-{name.replace(' ', '-')}")
        assert docs.columns == before, name
        yield name, docs
    name, stage = corpus_pipeline.STAGES[-1]
    yield name, stage(spark, docs, sf_dir)


def test_odd_documents_go_through_every_stage(spark, sf_dir):
    docs = spark.createDataFrame(rows(spark, sf_dir), SCHEMA).repartition(3)
    given, kept = Counter(r.doc_id for r in docs.collect()), None
    for name, out in through(spark, sf_dir, docs):
        found = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "packing":
            assert set(found) == set(kept)  # every document that is left has a piece
        else:
            assert not found - given, name
            kept = found
    assert sum(kept.values()) > 0


def test_an_empty_table_goes_through_every_stage(spark, sf_dir):
    for name, out in through(spark, sf_dir, spark.createDataFrame([], SCHEMA)):
        assert out.count() == 0, name
