"""Queries of the package that SQL can express, against their SQL."""

import pytest

import oracle
from uttera.llm import queries
from uttera.session import ship


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    ship(spark)
    oracle.compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], oracle.connection())
