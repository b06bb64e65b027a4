"""Error, finisher and completion KPIs per arm.

All inputs are the flagged event table of :func:`sessions.kpi_events`.  pandas drops null
group keys, so every per-arm aggregate first keeps the assigned arms (SURVEY T1).  Each
aggregate is a hash aggregate with a map-side partial step; distinct counts are planned
by Spark as a two-level aggregate keyed by (arm, client), so no single task sees all the
clients of an arm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_half_even
from ..functions.steps import ARMS


def _arms(df: DataFrame) -> DataFrame:
    return df.where(F.col("variation").isin(*ARMS))


def error_rate_by_step(events: DataFrame) -> DataFrame:
    """Mean of ``is_error`` per (step, arm) in percent, rounded to 2 digits."""
    return (_arms(events).where(F.col("step_num").isNotNull())
            .groupBy("step_num", "variation")
            .agg(round_half_even(F.avg(F.col("is_error").cast("double")) * 100, 2)
                 .alias("error_rate")))


def error_rate_pivot(events: DataFrame) -> DataFrame:
    """The same rates with one column per arm (explicit pivot values, one pass)."""
    return (error_rate_by_step(events).groupBy("step_num")
            .pivot("variation", ARMS).agg(F.first("error_rate"))
            .withColumnRenamed("Control", "control").withColumnRenamed("Test", "test"))


def error_summary(events: DataFrame) -> DataFrame:
    """Mean of the rounded per-step rates per arm, rounded to 2 digits."""
    return (error_rate_by_step(events).groupBy("variation")
            .agg(round_half_even(F.avg("error_rate"), 2).alias("error_rate_pct")))


def finishers(events: DataFrame) -> DataFrame:
    """The finish rows (all arms, as in the reference's finish table)."""
    return events.where(F.col("finish")).select(
        "client_id", "variation", "visit_id", "date_time", "event_seq", "attempt_no")


def arm_totals(events: DataFrame) -> DataFrame:
    """One two-level aggregate for every client-based KPI of an arm.

    Per (arm, client): highest attempt number, whether any finish row exists, and the
    number of distinct attempts with a finish row; then per arm: sums and counts of those.
    Both levels are partial aggregates, so a client with a huge history is reduced
    map-side, and the event table is read once for all four KPIs.
    """
    finish = F.col("finish")
    per_client = _arms(events).groupBy("variation", "client_id").agg(
        F.max("attempt_no").alias("_max_attempt"),
        F.max(finish.cast("int")).alias("_finished"),
        F.count_distinct(F.when(finish, F.col("attempt_no"))).alias("_fin_attempts"),
        F.max(finish & F.col("attempt_no").isNull()).alias("_fin_null_attempt"))
    return per_client.groupBy("variation").agg(
        F.sum("_finished").cast("long").alias("clients_finished"),
        F.count("*").alias("total_clients"),
        F.sum("_max_attempt").cast("long").alias("total_attempts"),
        (F.sum("_fin_attempts") + F.sum(F.col("_fin_null_attempt").cast("int")))
        .cast("long").alias("finished_attempts"))


def _finisher_rate(totals: DataFrame, keep: bool = False) -> DataFrame:
    """With ``keep`` the other columns stay beside the rate."""
    share = F.col("clients_finished") / F.col("total_clients") * 100
    others = totals.columns if keep else ["variation", "clients_finished", "total_clients"]
    return (totals.where(F.col("clients_finished") > 0)
            .select(*others, round_half_even(share, 2).alias("finisher_clients_pct")))


def _completion_rate(totals: DataFrame, keep: bool = False) -> DataFrame:
    rate = F.try_divide(F.col("finished_attempts"), F.col("total_attempts")) * 100
    others = totals.columns if keep else ["variation", "finished_attempts", "total_attempts"]
    return (totals.where(F.col("finished_attempts") > 0)
            .select(*others, round_half_even(rate, 2).alias("completion_rate_pct")))


def finisher_rate(events: DataFrame) -> DataFrame:
    """Distinct finishing clients over distinct clients per arm, in percent.

    Arms without any finisher have no row (the reference merges the two counts with an
    inner join).
    """
    return _finisher_rate(arm_totals(events))


def total_attempts(events: DataFrame) -> DataFrame:
    """Highest attempt number per client, summed per arm."""
    return arm_totals(events).select("variation", "total_attempts")


def finished_attempts(events: DataFrame) -> DataFrame:
    """Distinct (client, attempt) pairs with a finish row, per arm."""
    return (arm_totals(events).where(F.col("finished_attempts") > 0)
            .select("variation", "finished_attempts"))


def completion_rate(events: DataFrame) -> DataFrame:
    """Finished attempts over total attempts in percent (``try_divide``: an arm with
    no attempt gets null instead of an error)."""
    return _completion_rate(arm_totals(events))


def kpi_summary(events: DataFrame) -> DataFrame:
    """Completion, mean step error and finisher share per arm.

    Two aggregates over the event table (per step and per client), joined on the arm; arms
    without a finisher or a finished attempt have no row, as in the reference's inner joins.
    """
    rates = _finisher_rate(_completion_rate(arm_totals(events), keep=True), keep=True)
    return (rates.join(error_summary(events), "variation")
            .select("variation", "finished_attempts", "total_attempts", "completion_rate_pct",
                    "error_rate_pct", "finisher_clients_pct"))


def retry_clients(events: DataFrame, min_attempt: int = 2) -> DataFrame:
    """Assigned clients that went past ``min_attempt`` attempts."""
    return (_arms(events).where(F.col("attempt_no") > min_attempt)
            .groupBy("client_id", "variation")
            .agg(F.max("attempt_no").alias("max_attempt")))
