"""Every registered query beside its SQL on the smallest tables."""

import pytest

from ramus.plans import queries as Q
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    got, want = compare(spark, con, SF, Q.QUERIES[name], Q.ORACLE[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
