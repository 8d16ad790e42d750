"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import pytest

from graphloom.plans.registry import ORACLE, QUERIES
from tests.compare import assert_same, oracle
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SMALL), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
