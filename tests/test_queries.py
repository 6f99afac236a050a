import pytest
from oracle import compare

from tidejoin.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name])
