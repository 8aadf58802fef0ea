import llm_oracle
import pytest

from tokenloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, folder):
    assert llm_oracle.compare(QUERIES[name](spark, folder), ORACLES[name], folder) > 0
