import os

import duckdb
import pytest

import __spark_entry__ as driver
from skylattice.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return connection


def _sorted(rows, names, columns):
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted([tuple(value(r[names.index(c)]) for c in columns) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        result = sql.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert _sorted(rows, df.columns, sorted(names)) == _sorted(result.fetchall(), names, sorted(names))
    else:
        assert rows


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
