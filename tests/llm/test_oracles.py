"""The operators' SQL against their queries."""

import duckdb
import pytest

from splitlens.llm.registry import ORACLE, QUERIES
from tests.helpers import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert_same(QUERIES[key](spark, SF).toPandas(), con.execute(ORACLE[key]).df())
