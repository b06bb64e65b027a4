"""Lookups of one client or visit read few row groups of a clustered table."""

import pyarrow.parquet as pq
import pytest

from splitlens.operators import profile
from splitlens.sources.stage import clustered_table
from tests.helpers import assert_same

COLUMNS = ["client_id", "visit_id", "date_time", "event_seq"]


def rows_scanned(df):
    """Rows that left the file scans of an executed query."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan()
    todo, total = [final], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


@pytest.fixture(scope="module")
def tables(spark):
    events = spark.range(40000).selectExpr(
        "(id * 37) % 997 as client_id", "concat((id * 37) % 997, '_', id % 5) as visit_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) as date_time", "id as event_seq")
    events = events.repartition(4)
    spread = clustered_table(events, "spread", ["event_seq"], group_bytes=8192)
    near = clustered_table(events, "near", ["client_id", "date_time"], ["visit_id"], group_bytes=8192)
    return events, spread, near


def test_same_rows(tables):
    events, spread, near = tables
    for want in ({"client": 5}, {"visit": "5_2"}, {"client": -1}, {"visit": "none"}):
        expected = profile.trace(events, COLUMNS, **want).toPandas()
        assert_same(profile.trace(near, COLUMNS, **want).toPandas(), expected)
    got = profile.trace(near, COLUMNS, client=5).collect()
    assert got == sorted(got, key=lambda r: (r.date_time, r.event_seq)) and len(got) > 30


def test_fewer_rows_are_read(tables):
    events, spread, near = tables
    total = events.count()
    groups = sum(pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in near.inputFiles())
    assert groups >= 8
    for want in ({"client": 5}, {"visit": "5_2"}):
        far, close = (rows_scanned(profile.trace(t, COLUMNS, **want)) for t in (spread, near))
        assert close <= total / 5 and close <= far / 4


def test_one_of_the_two(tables):
    for bad in ({}, {"client": 1, "visit": "1_1"}):
        with pytest.raises(ValueError):
            profile.trace(tables[0], COLUMNS, **bad)
