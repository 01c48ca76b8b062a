"""Every registered query with an SQL statement gives the same rows as DuckDB."""

import pytest

from clientele.plans.registry import all_queries
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, q in all_queries().items() if q.oracle])
def test_same_rows_as_sql(spark, con, name):
    q = all_queries()[name]
    assert compare(q.run(spark, SF).toPandas(), con.execute(q.oracle).df()).startswith("ok")


def test_entry_runs(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
