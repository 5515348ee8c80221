import pytest
from oracle import check

from tarnlight.plans import analytic, completion, problems, relational

MODULES = (problems, relational, analytic, completion)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.SQL])
def test_query_equals_sql(spark, sf, name):
    m = next(m for m in MODULES if name in m.SQL)
    check(m.QUERIES[name], m.SQL[name], spark, sf)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES if n not in m.SQL])
def test_query_runs(spark, sf, name):
    m = next(m for m in MODULES if name in m.QUERIES)
    assert m.QUERIES[name](spark, sf).count() > 0


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
