"""Queries with an SQL statement give its rows; the others give a row per input row."""

import duckdb
import pytest

from clientele.llm import catalog
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle()))
def test_same_rows_as_sql(spark, name):
    got = catalog.runs()[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(catalog.oracle()[name]).df()).startswith("ok")


def test_all_operators_are_registered():
    import __spark_entry__ as e
    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names if n[2:3].isdigit()}) == list(range(1, 14))
    assert "pipeline" in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert duckdb.__version__
