"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query_matches_sql(spark, connection, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    if name in SQL:
        assert compare(frame, connection, SQL[name]) is None
    else:
        assert frame.count() > 0


def test_sql_has_no_stray_names():
    assert set(SQL) <= set(entry_points.queries())


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["day", "hour", "row_count"]
    assert frame.count() > 0
