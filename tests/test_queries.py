"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, SF).toArrow()
    if name in oracle_sql():
        assert differences(got, con.execute(oracle_sql()[name]).to_arrow_table()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry(spark).columns == ["hash", "size", "doc_id"]


def test_no_sql_without_a_query():
    assert set(oracle_sql()) <= set(queries())
