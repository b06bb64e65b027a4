"""Hand-written micro fixtures, one per semantic trap (FIXTURES.md section 5), run in
both the single-window and the segmented (skew-safe) plan."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from splitlens.functions.steps import STEPS
from splitlens.operators import cleaning, durations, sessions, stats
from splitlens.sources.csv import parse_timestamp_ntz

BASE = datetime(2024, 1, 1, 8, 0, 0)
SCHEMA = ("client_id long, visitor_id string, visit_id string, process_step string, "
          "date_time timestamp_ntz, event_seq long")
MODES = ["window", "segmented"]


def web(spark, steps, client=1, visit="1_7", seconds=None, start_seq=0):
    seconds = seconds or [10 * i for i in range(len(steps))]
    rows = [(client, f"{client}_0", visit, STEPS[s], BASE + timedelta(seconds=t), start_seq + i)
            for i, (s, t) in enumerate(zip(steps, seconds))]
    return spark.createDataFrame(rows, SCHEMA)


def events(df, mode):
    return sessions.kpi_events(df, mode).orderBy("date_time", "event_seq")


@pytest.mark.parametrize("mode", MODES)
def test_backtrack(spark, mode):
    out = events(web(spark, [0, 1, 2, 1, 2, 3, 4]), mode).collect()
    assert [r.is_error for r in out] == [False, False, True, False, False, False, False]
    assert [r.step_diff for r in out] == [None, 1, 1, -1, 1, 1, 1]


@pytest.mark.parametrize("mode", MODES)
def test_restart(spark, mode):
    out = events(web(spark, [0, 1, 2, 3, 4, 0, 1, 2, 3, 4]), mode).collect()
    assert [r.is_error for r in out] == [False] * 4 + [True] + [False] * 5
    assert [r.attempt_no for r in out] == [1] * 5 + [2] * 5
    assert [r.finish for r in out] == [False] * 9 + [True]


@pytest.mark.parametrize("mode", MODES)
def test_double_start_coded_rule(spark, mode):
    out = events(web(spark, [0, 0, 1, 2, 3, 4]), mode).collect()
    assert [r.attempt_no for r in out] == [0] * 6


@pytest.mark.parametrize("mode", MODES)
def test_restart_run(spark, mode):
    out = events(web(spark, [0, 1, 2, 3, 4, 0, 0, 1, 2, 3, 4]), mode).collect()
    assert [r.attempt_no for r in out] == [1] * 11


@pytest.mark.parametrize("mode", MODES)
def test_end_on_start(spark, mode):
    out = events(web(spark, [0, 1, 2, 3, 4, 0]), mode).collect()
    assert [r.attempt_no for r in out] == [1] * 5 + [2]


@pytest.mark.parametrize("mode", MODES)
def test_no_start(spark, mode):
    df = web(spark, [1, 2, 3, 4])
    assert [r.attempt_no for r in events(df, mode).collect()] == [0] * 4
    assert durations.process_durations(_merged(df), mode).count() == 0


def _merged(df):
    return (df.withColumn("clnt_age", F.lit(40.0)).withColumn("gendr", F.lit("F"))
            .withColumn("variation", F.lit("Test")))


@pytest.mark.parametrize("mode", MODES)
def test_repeat_steps_durations(spark, mode):
    df = web(spark, [0, 1, 2, 1, 2, 3, 4], seconds=[0, 10, 20, 30, 40, 50, 60])
    out = (durations.process_durations(_merged(df), mode)
           .orderBy("date_time", "event_seq").collect())
    assert [(r.date_time - BASE).seconds for r in out] == [0, 30, 40, 50, 60]
    assert [r.step_duration_sec for r in out] == [None, 30.0, 10.0, 10.0, 10.0]
    assert {r.all_steps_duration for r in out} == {60.0}
    assert {r.n_of_unique_steps for r in out} == {5}


@pytest.mark.parametrize("mode", MODES)
def test_late_backtrack(spark, mode):
    df = web(spark, [0, 1, 2, 3, 4, 3])
    out = (durations.process_durations(_merged(df), mode)
           .orderBy("date_time", "event_seq").collect())
    assert [r.process_step for r in out] == ["start", "step_1", "step_2", "confirm", "step_3"]
    assert {r.all_steps_duration for r in out} == {50.0}


def test_visit_text_order(spark):
    early = web(spark, [0, 1], client=9, visit="9_9")
    late = web(spark, [0, 1, 2], client=9, visit="9_10",
               seconds=[86400 * 5, 86400 * 5 + 10, 86400 * 5 + 20], start_seq=10)
    last = sessions.client_last_visit(_merged(early.unionByName(late))).collect()
    assert [(r.visit_id, r.last_reached_step) for r in last] == [("9_9", 2)]


@pytest.mark.parametrize("mode", MODES)
def test_same_second_follows_event_seq(spark, mode):
    rows = [(1, "1_0", "1_7", "step_1", BASE, 2), (1, "1_0", "1_7", "start", BASE, 1)]
    out = events(spark.createDataFrame(rows, SCHEMA), mode).collect()
    assert [r.event_seq for r in out] == [1, 2]
    assert [r.is_error for r in out] == [False, False]


def test_cross_part_duplicates_survive(spark):
    one = web(spark, [0, 1])
    pt1 = one.unionByName(one)          # duplicate within part 1
    pt2 = web(spark, [0])               # same row as part 1's first row
    clean = cleaning.web_log_clean(pt1, pt2)
    assert clean.count() == 3


def test_population_null_rules(spark):
    demo = spark.createDataFrame(
        [(1, 5.0, 30.0, None, 0.0), (2, 5.0, 40.0, "X", 0.0), (3, 5.0, None, "F", 0.0),
         (4, None, 50.0, "F", 0.0), (5, 6.0, 20.0, "F", 0.0)],
        "client_id long, clnt_tenure_yr double, clnt_age double, gendr string, bal double")
    clean = cleaning.demo_clean(demo)
    ages = {r.client_id: r.clnt_age for r in clean.collect()}
    assert 4 not in ages and ages[3] == 20.0        # tenure drop, then female mean
    exp = spark.createDataFrame([(1, None), (2, "Test"), (3, "Control")],
                                "client_id long, variation string")
    w = web(spark, [0, 1], client=1).unionByName(web(spark, [0], client=2, visit="2_7"))
    grouped = cleaning.web_with_groups(w, exp)
    pop = cleaning.kpi_population(clean, grouped)
    assert sorted({r.client_id for r in pop.collect()}) == [1, 3, 5]   # X removed
    master = cleaning.master(clean, grouped)
    assert master.count() == 2 + 1 + 1 + 1 + 0        # client 4 dropped by tenure


def test_bad_time_is_null(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("not a time",), ("2024-02-30 00:00:00",)],
                               "t string")
    got = [r.p for r in df.select(parse_timestamp_ntz(F.col("t")).alias("p")).collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5), None, None]


def test_one_arm_gives_null_statistics(spark):
    df = web(spark, [0, 1, 2, 3, 4]).withColumn("variation", F.lit("Control"))
    out = stats.ztest_completion(sessions.kpi_events(df)).collect()[0]
    assert out.z_stat is None and out.p_value is None


def documented(df, mode):
    flagged = sessions.error_flags(df, mode)
    return sessions.attempts_documented(flagged, mode).orderBy("date_time", "event_seq")


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("steps,expected", [
    ([0, 0, 1, 2, 3, 4], [0, 1, 1, 1, 1, 1]),
    ([0, 1, 2, 3, 4, 0, 0, 1, 2, 3, 4], [1] * 6 + [2] * 5),
    ([0, 1, 2, 3, 4, 0, 1, 2, 3, 4], [1] * 5 + [2] * 5),
    ([1, 2, 0, 1, 4, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 1]),
])
def test_documented_attempt_rule(spark, mode, steps, expected):
    # one event per day, so in segmented mode every row is its own segment
    df = web(spark, steps, seconds=[86400 * i for i in range(len(steps))])
    assert [r.attempt_no for r in documented(df, mode).collect()] == expected
