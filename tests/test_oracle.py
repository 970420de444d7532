import pytest

from heronry.plans import catalogue
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLE_SQL:
        assert difference(df, connect(sf_dir), catalogue.ORACLE_SQL[name]) is None
    else:
        assert df.count() >= 0
