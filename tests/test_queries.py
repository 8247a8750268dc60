"""Every registered query runs; those with SQL return what DuckDB returns."""

import pytest
from oracle import FOLDER, assert_same, connect

from marquee.plans import registry

FAMILIES = registry.families()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(FAMILIES))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in SQL:
        assert_same(got, con.execute(SQL[name]).df())


def test_entry_module_without_the_corpus_subpackage():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
