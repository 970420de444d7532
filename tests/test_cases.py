import pytest
from pyspark.sql import functions as F

from heronry.plans.base import shown
from tests.case_tables import CASES


@pytest.mark.parametrize(("name", "schema", "value", "table"), CASES, ids=[c[0] for c in CASES])
def test_rule_on_its_cases(spark, name, schema, value, table):
    rows = spark.createDataFrame([(i, *row[:-1]) for i, row in enumerate(table)], f"case int, {schema}").select("case", value().alias("value"))
    got = {r.case: r.value for r in rows.select("case", shown(F.col("value"), rows.schema["value"].dataType).alias("value")).collect()}
    assert [got[i] for i in range(len(table))] == [str(row[-1]) for row in table]
