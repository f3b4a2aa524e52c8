"""Every registered query that SQL can express agrees with its SQL; the others give finite rows."""

import pytest

import registered
from tests.compare import compare, connect

registered.load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registered.QUERIES) <= set(entry.queries())
