import pytest
from oracle import compare

from tokenloom.plans import extras, large, nested, networks  # noqa: F401
from tokenloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
