import pytest
from conftest import same_rows

from liftwork.plans import queries as q


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n in q.SQL])
def test_query_equals_sql(spark, sf, name):
    same_rows(q.QUERIES[name](spark, sf), q.SQL[name], sf)


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.SQL])
def test_query_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
