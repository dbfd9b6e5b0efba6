import pytest

from sparkloom.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_matches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert_matches(spark, QUERIES[name], ORACLES[name], SF)
