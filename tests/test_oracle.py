"""Every registered query against its DuckDB oracle at sf0.001."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    ok, msg = compare(got, con.execute(SQL[name]).df())
    assert ok, msg
