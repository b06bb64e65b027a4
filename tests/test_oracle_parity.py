"""Every registered query equals its independent DuckDB SQL on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from splitlens.plans import registry
from tests.helpers import assert_same

SF = "/root/testdata/sf0.001"
TABLES = ["events", "customer"]
SQL = entry.oracle_sql()
KEYS = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_parity(spark, con, key):
    got = entry.queries()[key](spark, SF).toPandas()
    want = con.execute(SQL[key]).df()
    assert_same(got, want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["variation", "finished_attempts", "total_attempts",
                          "completion_rate_pct", "error_rate_pct", "finisher_clients_pct"]
    assert df.count() >= 0
