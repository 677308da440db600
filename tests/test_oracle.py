"""Every market query against its SQL on the smallest tables."""

import pytest

from gridlens import oracles, queries
from tests.conftest import DATA, rows

Q, O = queries.queries(), oracles.oracle_sql()


def test_every_query_has_sql():
    assert set(Q) == set(O)


@pytest.mark.parametrize("name", sorted(Q))
def test_same_rows(spark, duck, name):
    got, want = Q[name](spark, DATA).toPandas(), duck.execute(O[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(O) <= set(e.oracle_sql())
