"""The segmented plans equal the single-window plans on tables with a hot client, a hot visit,
a hot instant and null visits; segments are even; plans shuffle and scan as they say."""

import random
import re
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from splitlens.functions.steps import STEPS
from splitlens.operators import durations, kpis, sequence, sessions
from splitlens.operators.sequence import SEGMENT, find_heat
from splitlens.plans.pipeline import Stages
from tests.helpers import assert_same

SCHEMA = ("client_id long, visitor_id string, visit_id string, process_step string, "
          "date_time timestamp_ntz, event_seq long, clnt_age double, gendr string, "
          "variation string")
COLUMNS = ["client_id", "event_seq", "step_num", "step_diff", "is_error", "attempt_no", "finish"]
SF = "/root/testdata/sf0.01"


def skewed(spark, n_hot=3000, n_other=400, seed=7, null_visits=0.0, gaps=(0, 1, 30, 600, 7200)):
    """A client with most rows (in visits of five days), twenty others, and rows without a
    visit and a time."""
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows, seq = [], 0
    for client, n in [(1, n_hot)] + [(c, n_other // 20) for c in range(2, 22)]:
        t = base
        for _ in range(n):
            t += timedelta(seconds=rnd.choice(gaps))
            visit = f"{client}_{7 + (t - base).days // 5}"
            rows.append((client, f"{client}_0", visit, STEPS[rnd.randrange(5)], t, seq,
                         40.0, "F", "Test"))
            seq += 1
    rows += [(100 + i, None, None, None, None, None, 40.0, "F", None)
             for i in range(int(null_visits * len(rows)))]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


#: a spread history; one hot visit-day; one instant with most rows of it; every row repeated
TABLES = {
    "spread": {"gaps": (0, 1, 30, 600, 7200, 40000)},
    "hot visit-day": {"gaps": (0, 1, 2, 20), "null_visits": 0.1},
    "hot instant": {"gaps": (0,) * 60 + (1, 400), "null_visits": 0.1},
    "one instant": {"gaps": (0,)},
}


@pytest.mark.parametrize("name, rows", [("hot visit-day", 60), ("hot instant", 20), ("one instant", 50)])
def test_sequences_equal(spark, name, rows):
    df = skewed(spark, n_hot=900, n_other=200, **TABLES[name])
    df = df.unionByName(df.where("event_seq % 9 = 0"))  # copies that survive the cleaning
    want = sessions.kpi_events(df, "window").select(*COLUMNS).toPandas()
    got = sessions.kpi_events(df, rows=rows).select(*COLUMNS).toPandas()
    assert_same(got, want)


@pytest.mark.parametrize("name", ["spread"])
def test_documented_attempts_equal(spark, name):
    df = skewed(spark, n_hot=900, n_other=200, **TABLES[name])
    flagged = sessions.error_flags(df, "window")
    want = sessions.attempts_documented(flagged, "window").toPandas()
    assert_same(sessions.attempts_documented(flagged, rows=30, counted=df).toPandas(), want)


@pytest.mark.parametrize("name", ["hot visit-day", "one instant"])
def test_durations_equal(spark, name):
    df = skewed(spark, n_hot=900, n_other=200, **TABLES[name])
    want = durations.process_durations(df, "window").toPandas()
    assert_same(durations.process_durations(df, rows=20).toPandas(), want)
    want = sessions.steps_by_visit(df, "window").toPandas()
    assert_same(sessions.steps_by_visit(df, rows=20).toPandas(), want)


@pytest.mark.parametrize("name, key", [("spread", "client_id"), ("hot visit-day", "visit_id"),
                                       ("hot instant", "client_id"), ("one instant", "visit_id")])
def test_no_segment_is_above_twice_the_median(spark, name, key):
    """(Rows of one instant stay together up to a segment's size, so instants of about that
    size give uneven segments, but none above the bound.)"""
    df = skewed(spark, n_hot=6000, **TABLES[name])
    heat, nulls = find_heat(df, [key], sessions.ORDER, rows=200)
    assert nulls == (key == "visit_id" and "null_visits" in TABLES[name])
    cut = heat.add_segment(df)
    assert cut.count() == df.count()
    hot = cut.where(F.col(SEGMENT).isNotNull()).groupBy(key, SEGMENT).count().collect()
    sizes = [r["count"] for r in hot]
    assert len(sizes) > 10 and max(sizes) <= 200
    assert name == "hot instant" or max(sizes) <= 2 * median(sizes)
    cold = cut.where(F.col(SEGMENT).isNull() & F.col(key).isNotNull()).groupBy(key).count()
    assert cold.agg(F.max("count")).first()[0] <= 200
    # segments rise along the order
    ordered = cut.where(F.col(SEGMENT).isNotNull()).orderBy(
        key, "date_time", "event_seq").select(key, SEGMENT).collect()
    assert all(a[1] <= b[1] for a, b in zip(ordered, ordered[1:]) if a[0] == b[0])


def test_tasks_are_even(spark):
    """No task of the scans' shuffle reads above twice the median, with a hot visit-day and a
    tenth of the rows without a visit."""
    df = skewed(spark, n_hot=20000, n_other=4000, **TABLES["hot visit-day"])
    present, _ = sequence.split_null_keys(df, ["visit_id"])
    heat, _ = find_heat(df, ["visit_id"], sessions.ORDER, rows=24000 // (8 * 32))
    dealt = heat.add_segment(present).repartition(8, "visit_id", SEGMENT)
    tasks = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 8 and max(tasks) <= 2 * median(tasks)


def test_no_hot_key_adds_nothing(spark):
    df = skewed(spark)
    assert find_heat(df, ["client_id"], sessions.ORDER) == (None, False)
    assert find_heat(df, ["client_id"], sessions.ORDER, mode="window", rows=1)[0] is None
    assert find_heat(df.limit(0), ["client_id"], sessions.ORDER, rows=1) == (None, False)


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def nodes(df):
    p = plan(df)
    return {"scans": p.count("FileScan parquet"), "shuffles": p.count("Exchange hashpartitioning"),
            "sorts": len(re.findall(r"\bSort \[", p))}


def test_plans_keep_their_promises(spark):
    s = Stages.shared(spark, SF)
    assert nodes(durations.process_durations(s.merged_events)) == {"scans": 1, "shuffles": 1, "sorts": 1}
    # by visit and by client; the second scan is of the rows without a visit
    assert nodes(sessions.kpi_events(s.kpi_population)) == {"scans": 2, "shuffles": 2, "sorts": 2}
    assert nodes(kpis.kpi_summary(s.kpi_events))["scans"] == 2
    read = re.findall(r"ReadSchema: struct<(.*?)>", plan(kpis.kpi_summary(s.kpi_events)).replace("...", ""))
    assert "ExistingRDD" not in plan(kpis.kpi_summary(s.kpi_events)) and read
    for scan in re.findall(r"FileScan parquet \[(.*?)\]", plan(kpis.error_summary(s.kpi_events))):
        assert {c.split("#")[0] for c in scan.split(",")} == {"variation", "step_num", "is_error"}
