"""Every query against its SQL, and those without SQL against their own properties."""

import pytest

import oracle
from uttera.plans.queries import QUERIES, SQL
from uttera.session import ship


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    oracle.compare(spark, name, QUERIES[name], SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    ship(spark)
    assert QUERIES[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
