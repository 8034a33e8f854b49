"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import connect, difference, type_difference


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    got = df.toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert type_difference(df, con.sql(sql)) == ""
        assert difference(got, con.sql(sql).df()) == ""


def test_flagship(spark, small):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
