"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import differences, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf_dir, connection, name):
    got = queries()[name](spark, sf_dir).toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert differences(got, connection.execute(sql).df()) == ""


def test_entry(spark):
    assert len(entry(spark).take(1)) == 1
