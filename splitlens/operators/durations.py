"""Step and process durations per visit.

One ``(client_id, visit_id)`` key throughout: per-visit maxima of each step's time
(A5), the rows kept from the last ``start`` on with only the last occurrence of every
later step (P18/P19), the time since the previous kept row (W7) and the visit's total
span over kept rows (W8).  All of it runs over one partitioning and one order, so the event
table is shuffled and sorted once.  Visits with more rows than a task should get are cut
into segments (``sequence``): their maxima are partial aggregates, and one summary row per
segment gives the previous kept time and the span.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_half_even, stable
from ..functions.steps import ARMS
from .sequence import (SEGMENT, WHOLE, find_heat, group_values, hot_rows, linked,
                       segments_of, window_order)
from .sessions import ORDER, last_row_per_client

KEYS = ["client_id", "visit_id"]
# step name -> column holding that step's last time in the visit (dashboard schema)
LAST_TIME_COLUMNS = {
    "start": "last_start_time",
    "step_1": "last_step1_time",
    "step_2": "last_step2_time",
    "step_3": "last_step3_time",
    "confirm": "last_confirm_time",
}
DURATION_COLUMNS = [
    "client_id", "clnt_age", "gendr", "variation", "visitor_id", "visit_id", "date_time",
    "process_step", "n_of_unique_steps", *LAST_TIME_COLUMNS.values(), "step_duration",
    "step_duration_min", "step_duration_sec", "all_steps_duration", "all_steps_dur_min",
    "all_steps_dur_hr", "event_seq",
]


def _seconds_between(start, end):
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def _spans(kept: DataFrame) -> DataFrame:
    """Add the previous kept time and the visit's first and last kept time."""
    t = F.col("date_time")
    by = [*KEYS, SEGMENT] if SEGMENT in kept.columns else KEYS
    w = Window.partitionBy(*by).orderBy(*window_order(ORDER))
    d = kept.withColumns({"_prev_time": F.lag("date_time").over(w),
                          "_t0": F.min(t).over(w.rowsBetween(*WHOLE)),
                          "_t1": F.max(t).over(w.rowsBetween(*WHOLE))})
    if SEGMENT not in kept.columns:
        return d
    # times never fall along the order, so a segment's last one is its largest
    ends = hot_rows(kept).groupBy(*by).agg(F.min(t).alias("_s0"), F.max(t).alias("_s1"))
    over = segments_of(KEYS)
    ends = ends.select(*by, F.lag("_s1").over(over).alias("_prev_seg"),
                       F.min("_s0").over(over.rowsBetween(*WHOLE)).alias("_g0"),
                       F.max("_s1").over(over.rowsBetween(*WHOLE)).alias("_g1"))
    return linked(d, KEYS, ends).withColumns({
        "_prev_time": F.coalesce("_prev_time", "_prev_seg"),
        "_t0": F.coalesce("_g0", "_t0"), "_t1": F.coalesce("_g1", "_t1")})


def process_durations(merged: DataFrame, mode: str = "segmented",
                      rows: int | None = None) -> DataFrame:
    """C4: kept rows of each visit with step and total durations (seconds, minutes,
    hours; intervals are reported as seconds).  ``merged`` should be a stage table."""
    heat, _ = find_heat(merged, KEYS, ORDER, mode, rows)
    d = merged.select("client_id", "clnt_age", "gendr", "variation", "visitor_id", "visit_id",
                      "date_time", "process_step", "event_seq")
    # rows without a visit or a time are never kept, nor part of a visit's maxima
    d = d.where(F.col("visit_id").isNotNull() & F.col("client_id").isNotNull())
    d = d if heat is None else heat.add_segment(d)
    step, t = F.col("process_step"), F.col("date_time")

    def last(name):
        return F.max(F.when(step == name, t))

    count = "n_of_unique_steps"
    d = group_values(
        d, KEYS, ORDER,
        {count: lambda w: F.size(F.collect_set(step).over(w)).cast("long"),
         **{col: lambda w, name=name: last(name).over(w) for name, col in LAST_TIME_COLUMNS.items()}},
        {count: F.count_distinct(step),
         **{col: last(name) for name, col in LAST_TIME_COLUMNS.items()}})

    keep = F.coalesce(t >= F.col("last_start_time"), F.lit(False))
    for name in ("confirm", "step_1", "step_2", "step_3"):
        stale = (step == name) & (t < F.col(LAST_TIME_COLUMNS[name]))
        keep = keep & ~F.coalesce(stale, F.lit(False))
    d = _spans(d.where(keep))

    step_sec = _seconds_between(F.col("_prev_time"), t)
    all_sec = _seconds_between(F.col("_t0"), F.col("_t1"))
    d = (d.withColumn("step_duration", step_sec)
         .withColumn("step_duration_min", round_half_even(step_sec / 60, 2))
         .withColumn("step_duration_sec", step_sec)
         .withColumn("all_steps_duration", all_sec)
         .withColumn("all_steps_dur_min", round_half_even(all_sec / 60, 2))
         .withColumn("all_steps_dur_hr", round_half_even(all_sec / 3600, 3)))
    return d.select(*DURATION_COLUMNS)


def step_by_step(durations: DataFrame) -> DataFrame:
    """The kept rows sorted by client, visit and time, for reading and export.  A global
    sort is a range shuffle; nothing downstream needs it."""
    return durations.orderBy("client_id", "visit_id", *window_order(ORDER))


def completion_durations(durations: DataFrame) -> DataFrame:
    """For clients with a five-step visit, the last kept row of their last such visit
    (visit_id compared as text)."""
    five = durations.where(F.col("n_of_unique_steps") == 5)
    # Two copies of one event (kept across web-log parts) tie on every sort key; the later
    # copy is the one whose previous row is its twin, i.e. the smaller step duration.
    later_copy = -F.coalesce(F.col("step_duration"), F.lit(float("inf")))
    return last_row_per_client(five, DURATION_COLUMNS, later_copy)


def duration_stats(completions: DataFrame) -> DataFrame:
    """Mean / max / min total minutes per arm among completers."""
    return (completions.where(F.col("variation").isin(*ARMS)).groupBy("variation")
            .agg(stable(F.avg("all_steps_dur_min")).alias("avg_min"),
                 F.max("all_steps_dur_min").alias("max_min"),
                 F.min("all_steps_dur_min").alias("min_min")))


