import pytest
from oracle import check

from tarnlight.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query_equals_sql(spark, sf, name):
    check(Q.QUERIES[name], Q.SQL[name], spark, sf)


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.SQL])
def test_query_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0
