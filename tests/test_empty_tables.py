"""Queries that write, stream or look a value up on the driver run over empty tables; the entry module imports before there is a session."""

import os
import subprocess
import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from heronry.plans import catalogue


@pytest.fixture(scope="module")
def nothing(sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in os.listdir(sf_dir):
        pq.write_table(pq.read_table(f"{sf_dir}/{name}").slice(0, 0), folder / name)
    return str(folder)


#: The others are one plan from tables to result.
LOOKS_UP = ("sch_", "mat_05", "srt_11", "srt_14", "src_22", "stm_0", "stm_13", "stm_14", "snk_0", "snk_1", "joi_03", "joi_16", "fil_16", "str_29", "ops_05", "ops_06", "gra_01", "gra_04", "agg_35")


@pytest.mark.parametrize("name", sorted(n for n in catalogue.QUERIES if n.startswith(LOOKS_UP)))
def test_query_over_empty_tables(spark, nothing, name):
    assert catalogue.QUERIES[name](spark, nothing).count() >= 0


def test_the_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=120)
