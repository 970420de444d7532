"""Queries against their SQL on small tables of their own: ties, large ids and signs that the given tables seldom hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from heronry.functions import lexical as L
from heronry.operators import records
from heronry.plans import catalogue
from tests.oracle import difference
from tests.plan_rows import rows_of_joins


def differs(spark, tmp_path, name, **tables):
    """What a query over these tables has other than its SQL."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    return difference(catalogue.QUERIES[name](spark, str(tmp_path)), con, catalogue.ORACLE_SQL[name])


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


PARTS = "p_partkey long, p_brand string, p_type string, p_retailprice double"


def test_three_nearest_prices_with_ties_and_nulls(spark, tmp_path):
    prices = [5.0, 5.0, 7.0, 3.0, 6.0, 4.0, None, 5.0, 5.0, 5.0, None, 11.0, 3.0, 7.0]
    rows = [(k * 7 % 31, "b", "t", p) for k, p in enumerate(prices)] + [(100, "b", "u", 1.0), (101, "b", "v", None), (102, "b", "v", 2.0), (103, "b", "v", None), (104, None, "v", 2.0), (105, None, "v", 2.0)]
    assert differs(spark, tmp_path, "joi_24_top_three", part=spark.createDataFrame(rows, PARTS)) is None


def test_nearest_prices_do_not_pair_a_group(spark):
    parts = spark.range(3000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), (F.col("id") % 50).cast("double").alias("p_retailprice"))
    df = records.nearest_by_value(parts, "p_partkey", ["p_brand", "p_type"], "p_retailprice", 3)
    assert len(df.collect()) == 9000 and max(rows_of_joins(df)) <= 3000


@pytest.mark.parametrize("ids", [[0, 1, 26, 299_995, 299_996, 299_997, 5_000_000]])
def test_steps_above_the_largest(spark, tmp_path, ids):
    assert differs(spark, tmp_path, "mat_13_axis_step", documents=documents(spark, [(i, "x") for i in ids])) is None


def test_titles_with_addresses_and_signs(spark, tmp_path):
    titles = ["a.b@c.example Ann bo cy dee", "and Ann bo cy", "Ann and and and", "ann bo; cy dee", "(ann bo) cy dee", "ann > bo cy dee", "ann bo cy d@e", "ann bo cy dee", "ann bo c,y dee"]
    rows = [(i, "u", f"<html><body><p>x</p><article><h1>{t}</h1><p>y</p></article></body></html>") for i, t in enumerate(titles)]
    assert differs(spark, tmp_path, "src_16_page_header", pages=spark.createDataFrame(rows, "page_id long, url string, html string")) is None


def test_equal_scores_of_texts_of_other_lengths(spark, tmp_path):
    rows = [(0, "that " * 5), *[(i, "that") for i in range(1, 30)], (30, "of " * 7), (31, "x")]
    assert differs(spark, tmp_path, "sch_09_embedded", documents=documents(spark, rows)) is None


def test_words_of_a_pair_are_made_once(spark, tmp_path):
    df = documents(spark, [(0, "of the"), (1, "off the"), (2, "of-the x.of"), (3, "of the()"), (4, "the of"), (5, "")])
    assert differs(spark, tmp_path, "str_05_adjacent", documents=df) is None
    plan = df.select(L.word_pairs(L.reading_words("text")).alias("pairs"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
