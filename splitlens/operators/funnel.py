"""Funnel, step distributions and step crosstabs.

The heavy part of each is one distinct-count aggregate (planned two-level by Spark);
the ratio windows then run over at most arms x steps rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_half_even
from ..functions.steps import ARMS, UNASSIGNED_LABEL, step_num
from .sessions import client_last_visit


def funnel(merged: DataFrame) -> DataFrame:
    """Clients per (arm, step) in funnel order, conversion to the arm's first step
    (percent, 2 digits) and drop-off from the previous step (percent, unrounded).
    Unknown step names are dropped, the unassigned arm is kept as ``Others``."""
    counts = (merged.withColumn("step_num", step_num("process_step"))
              .where(F.col("step_num").isNotNull())
              .groupBy("variation", "process_step", "step_num")
              .agg(F.count_distinct("client_id").alias("n_clients")))
    w = Window.partitionBy("variation").orderBy("step_num")
    first = F.first("n_clients").over(w.rowsBetween(Window.unboundedPreceding,
                                                     Window.unboundedFollowing))
    n = F.col("n_clients")
    return counts.select(
        "variation", "process_step", "step_num", "n_clients",
        round_half_even(n / first * 100, 2).alias("conversion_rate"),
        ((F.lit(1) - n / F.lag("n_clients").over(w)) * 100).alias("dropoff_rate"))


FUNNEL_ARMS = [ARMS[0], UNASSIGNED_LABEL, ARMS[1]]


def funnel_pivot(merged: DataFrame) -> DataFrame:
    """One row per step, conversion and drop-off columns per arm."""
    wide = (funnel(merged).groupBy("process_step", "step_num")
            .pivot("variation", FUNNEL_ARMS)
            .agg(F.first("conversion_rate").alias("conversion_rate"),
                 F.first("dropoff_rate").alias("dropoff_rate")))
    cols = [F.col("process_step"), F.col("step_num")]
    for measure in ("conversion_rate", "dropoff_rate"):
        for arm in FUNNEL_ARMS:
            cols.append(F.col(f"{arm}_{measure}").alias(f"{measure}_{arm.lower()}"))
    return wide.select(*cols)


def steps_per_client(merged: DataFrame) -> DataFrame:
    """A2: distinct steps per client over all visits (0 for clients without events)."""
    return merged.groupBy("client_id").agg(F.count_distinct("process_step").alias("n_steps"))


def step_distribution(merged: DataFrame) -> DataFrame:
    """A3/O3: number of clients per distinct-step count, most clients first."""
    return (steps_per_client(merged).groupBy("n_steps")
            .agg(F.count("*").alias("n_clients"))
            .orderBy(F.col("n_clients").desc(), "n_steps"))


def step_distribution_pct(merged: DataFrame) -> DataFrame:
    """A4/O3: the same distribution normalised to shares (total as a scalar subquery),
    most clients first."""
    dist = step_distribution(merged)
    total = dist.agg(F.sum("n_clients")).scalar()
    return (dist.withColumn("share", F.col("n_clients") / total)
            .orderBy(F.col("n_clients").desc(), "n_steps"))


def steps_crosstab(merged: DataFrame) -> DataFrame:
    """Distinct steps reached in each client's last visit x arm, counts and row
    percentages, unassigned clients excluded."""
    last = client_last_visit(merged).where(F.col("variation") != UNASSIGNED_LABEL)
    counts = last.groupBy(F.col("n_of_unique_steps").alias("n_steps")).agg(
        F.count(F.when(F.col("variation") == "Control", 1)).alias("control"),
        F.count(F.when(F.col("variation") == "Test", 1)).alias("test"))
    total = F.col("control") + F.col("test")
    return counts.select(
        "n_steps", "control", "test",
        (F.col("control") / total * 100).alias("control_pct"),
        (F.col("test") / total * 100).alias("test_pct"))
