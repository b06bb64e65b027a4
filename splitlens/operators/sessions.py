"""Step sequences per visit and per client.

Three keys, kept distinct as in the reference: errors are per ``visit_id`` alone, steps
reached per ``(client_id, visit_id)``, attempts per ``client_id`` across visits.  Every
ordered scan orders by ``date_time`` (nulls last) and then ``event_seq`` so that rows in
the same second have a deterministic order (SURVEY T4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import step_num
from .sequence import (BEFORE, SEGMENT, UP_TO, carry_forward, find_heat, group_values,
                       hot_rows, linked, neighbours, running_sum, segments_of,
                       split_null_keys, window_order)

ORDER = ["date_time", "event_seq"]


def _scanned(df: DataFrame, keys: list[str], mode: str, rows: int | None,
             counted: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows ready for an ordered scan by ``keys`` (with segments if there are hot keys), and
    the rows with a null key if there are any.  ``counted`` is the stored table that ``df``
    adds columns to, so that its keys are counted without computing those."""
    heat, nulls = find_heat(df if counted is None else counted, keys, ORDER, mode, rows)
    present, rest = split_null_keys(df, keys) if nulls else (df, None)
    return (present if heat is None else heat.add_segment(present)), rest


def _with_rest(scanned: DataFrame, rest: DataFrame | None) -> DataFrame:
    """The scanned rows and the rows without a key, whose results are null."""
    out = scanned.drop(SEGMENT)
    if rest is None:
        return out
    added = {n: F.lit(None).cast(kind) for n, kind in out.dtypes if n not in rest.columns}
    return out.unionByName(rest.withColumns(added))


def error_flags(df: DataFrame, mode: str = "segmented", rows: int | None = None,
                counted: DataFrame | None = None) -> DataFrame:
    """``step_diff`` to the previous step of the visit and ``is_error`` on the row
    whose *next* move in the visit goes backwards (a restart after confirm counts,
    SURVEY T5).  Rows without a visit get null flags (SURVEY T20)."""
    d = df.withColumn("step_num", step_num("process_step"))
    d, rest = _scanned(d, ["visit_id"], mode, rows, df if counted is None else counted)
    d = neighbours(d, ["visit_id"], ORDER, "step_num", "_prev_step", "_next_step")
    d = (d.withColumn("step_diff", F.col("step_num") - F.col("_prev_step"))
         .withColumn("is_error", F.coalesce(F.col("_next_step") < F.col("step_num"),
                                            F.lit(False))))
    return _with_rest(d.drop("_prev_step", "_next_step"), rest)


def _opens(step, prev, nxt):
    """The coded attempt rule for one row given its previous and next step."""
    return (F.coalesce(step == 0, F.lit(False))
            & (prev.isNull() | F.coalesce(prev == 4, F.lit(False)))
            & F.coalesce(nxt != 0, F.lit(True)))


def attempts(df: DataFrame, mode: str = "segmented", rows: int | None = None,
             counted: DataFrame | None = None) -> DataFrame:
    """Attempt number per client over all visits, the rule as coded.

    A row opens an attempt when it is a ``start``, the client's previous step is
    ``confirm`` or absent, and the next step is not another ``start``.  The attempt number
    is the running count of such rows, 0 before the first one (SURVEY T7).  Rows without a
    client get a null number.  Needs ``step_num`` (see :func:`error_flags`).
    """
    d, rest = _scanned(df, ["client_id"], mode, rows, counted)
    if SEGMENT in d.columns:
        d = _attempts_by_segment(d)
    else:
        d = neighbours(d, ["client_id"], ORDER, "step_num", "_prev", "_next")
        opens = _opens(F.col("step_num"), F.col("_prev"), F.col("_next"))
        d = running_sum(d.withColumn("_opens", opens.cast("int")), ["client_id"], ORDER,
                        "_opens", "attempt_no")
        d = d.drop("_prev", "_next", "_opens")
    return _with_rest(d.withColumn("attempt_no", F.col("attempt_no").cast("int")), rest)


def attempts_documented(df: DataFrame, mode: str = "segmented", rows: int | None = None,
                        counted: DataFrame | None = None) -> DataFrame:
    """W3-W6, the rule as documented: a run of consecutive
    starts collapses to its last start, which opens an attempt when the step before the
    run is ``confirm`` or there is none.  (An unknown step before the run counts as a
    missing one, as in the coded rule.)  Needs ``step_num``."""
    step, keys = F.col("step_num"), ["client_id"]
    not_start = F.when(F.coalesce(step != 0, F.lit(True)), F.coalesce(step, F.lit(-1)))
    d, rest = _scanned(df, keys, mode, rows, counted)
    d = carry_forward(d, keys, ORDER, not_start, "_before_run")
    d = neighbours(d, keys, ORDER, "step_num", "_prev", "_next")
    opens = (F.coalesce(step == 0, F.lit(False))
             & F.coalesce(F.col("_next") != 0, F.lit(True))
             & (F.col("_before_run").isNull() | F.col("_before_run").isin(4, -1)))
    d = running_sum(d.withColumn("_opens", opens.cast("int")), keys, ORDER, "_opens",
                    "attempt_no")
    d = d.drop("_before_run", "_prev", "_next", "_opens")
    return _with_rest(d.withColumn("attempt_no", F.col("attempt_no").cast("int")), rest)


def _attempts_by_segment(df: DataFrame) -> DataFrame:
    """Attempts with one segment summary: neighbours across segments and the running
    attempt offset come from the same one-row-per-segment table.

    Inside a segment every row but the first and the last sees both neighbours, so its
    flag and running sum are local.  The summary carries each segment's first, second,
    second-to-last and last step, the local flag sum and the row count; a window over the
    summary links segments, evaluates the two boundary flags and accumulates the offset.
    A key without segments is one segment: its boundary flags see no other.
    """
    keys = ["client_id", SEGMENT]
    inside = Window.partitionBy(*keys).orderBy(*window_order(ORDER))
    step = F.col("step_num")
    d = df.withColumns({
        "_prev_in": F.lag("step_num").over(inside),
        "_next_in": F.lead("step_num").over(inside),
        "_first": F.lag(F.lit(1)).over(inside).isNull(),
        "_last": F.lead(F.lit(1)).over(inside).isNull()})
    flag = _opens(step, F.col("_prev_in"), F.col("_next_in")).cast("int")
    edge = F.col(SEGMENT).isNotNull() & (F.col("_first") | F.col("_last"))
    d = d.withColumn("_local", F.when(edge, F.lit(0)).otherwise(flag))
    run = d.withColumn("_run_local", F.sum("_local").over(inside.rowsBetween(*UP_TO)))

    summary = hot_rows(d).groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.max(F.when(F.col("_first"), step)).alias("_s_first"),
        F.max(F.when(F.col("_first"), F.col("_next_in"))).alias("_s_second"),
        F.max(F.when(F.col("_last"), F.col("_prev_in"))).alias("_s_second_last"),
        F.max(F.when(F.col("_last"), step)).alias("_s_last"),
        F.sum("_local").alias("_s_local"))
    over = segments_of(["client_id"])
    summary = summary.withColumns({
        "_prev_seg": F.lag("_s_last").over(over),
        "_next_seg": F.lead("_s_first").over(over)})
    many = F.col("_n") > 1
    first_open = _opens(F.col("_s_first"), F.col("_prev_seg"),
                        F.when(many, F.col("_s_second")).otherwise(F.col("_next_seg")))
    last_open = _opens(F.col("_s_last"), F.col("_s_second_last"), F.col("_next_seg"))
    summary = summary.withColumns({
        "_first_open": first_open.cast("int"),
        "_last_open": F.when(many, last_open.cast("int")).otherwise(F.lit(0))})
    opened = F.col("_first_open") + F.col("_s_local") + F.col("_last_open")
    summary = summary.select(*keys, "_first_open", "_last_open", F.sum(opened).over(
        over.rowsBetween(*BEFORE)).alias("_offset"))
    out = linked(run, ["client_id"], summary)
    at_end = F.when(F.col("_last") & ~F.col("_first"), F.col("_last_open"))
    attempt = F.col("_run_local") + sum(
        F.coalesce(c, F.lit(0)) for c in (F.col("_offset"), F.col("_first_open"), at_end))
    return (out.withColumn("attempt_no", attempt)
            .drop("_prev_in", "_next_in", "_first", "_last", "_local", "_run_local",
                  "_first_open", "_last_open", "_offset"))


def finish_flag(df: DataFrame) -> DataFrame:
    """The row is a confirm that is not itself the origin of a backward move."""
    return df.withColumn("finish", F.coalesce(
        (F.col("step_num") == 4) & ~F.col("is_error"), F.lit(False)))


def kpi_events(population: DataFrame, mode: str = "segmented",
               rows: int | None = None) -> DataFrame:
    """The flagged event table read by every KPI: error flags, attempts, finish.  Hot visits
    and clients are looked for in ``population``, which should be a stage table."""
    flagged = error_flags(population, mode, rows, population)
    return finish_flag(attempts(flagged, mode, rows, population))


def steps_by_visit(df: DataFrame, mode: str = "segmented", rows: int | None = None) -> DataFrame:
    """Distinct steps of the row's (client, visit) and the Yes/No flag."""
    keys = ["client_id", "visit_id"]
    d, rest = _scanned(df, keys, mode, rows, None)
    name, step = "n_of_unique_steps", "process_step"
    d = group_values(d, keys, ORDER,
                     {name: lambda w: F.size(F.collect_set(step).over(w)).cast("long")},
                     {name: F.count_distinct(step)})
    d = _with_rest(d, rest)
    return d.withColumn("completed_steps", F.when(F.col(name) == 5, F.lit("Yes"))
                        .otherwise(F.lit("No")))


def _last_row_key(*tie_breaks):
    """Sort key of "last row of a client": visit_id as text, then time
    (nulls last, as pandas sorts), then event_seq, then ``tie_breaks``."""
    return F.struct(F.col("visit_id"), F.col("date_time").isNull(), F.col("date_time"),
                    F.col("event_seq"), *tie_breaks)


def last_row_per_client(df: DataFrame, columns: list[str], *tie_breaks) -> DataFrame:
    """The last row of each client in (visit_id, date_time, event_seq) order.

    ``max_by`` is an ordinary partial aggregate, so a client with millions of rows is
    reduced map-side instead of being sorted in one task.  ``tie_breaks`` order rows that
    are copies of one event but carry different derived values.
    """
    picked = df.groupBy("client_id").agg(
        F.max_by(F.struct(*[c for c in columns if c != "client_id"]),
                 _last_row_key(*tie_breaks)).alias("_row"))
    return picked.select("client_id", "_row.*")


def client_last_visit(df: DataFrame) -> DataFrame:
    """Each client's last visit (visit_id compared as text) with the number of
    distinct steps reached in it; rows without a visit drop out."""
    rows = df.where(F.col("visit_id").isNotNull())
    last = last_row_per_client(rows, ["client_id", "visit_id", "variation", "process_step",
                                      "date_time", "event_seq"])
    steps = (rows.groupBy("client_id", "visit_id")
             .agg(F.count_distinct("process_step").alias("n_of_unique_steps")))
    return (last.join(steps, ["client_id", "visit_id"], "left")
            .withColumn("last_reached_step", F.col("n_of_unique_steps")))
