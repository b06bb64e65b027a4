"""Dashboard aggregates over the duration tables.

Each is a single grouped average over a duration table with arm (and gender) member
filters that Catalyst pushes below the projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import (LEFT_CLOSED, RIGHT_CLOSED, age_band_left_closed,
                               age_band_right_closed, band_order)
from ..functions.rounding import stable
from ..functions.steps import ARMS, step_num

GENDERS_FM = ["F", "M"]
LOG_BINS_PER_DECADE = 4


def _arms(df: DataFrame) -> DataFrame:
    return df.where(F.col("variation").isin(*ARMS))


def duration_by_age(completions: DataFrame) -> DataFrame:
    """Mean total minutes per arm x right-closed age band."""
    band = age_band_right_closed(F.col("clnt_age"))
    return (_arms(completions).where(band.isNotNull())
            .groupBy("variation", band.alias("age_band"))
            .agg(stable(F.avg("all_steps_dur_min")).alias("avg_min"))
            .withColumn("band_order", band_order(F.col("age_band"), RIGHT_CLOSED)))


def duration_by_gender(completions: DataFrame) -> DataFrame:
    """Mean total minutes per gender x arm, F and M only."""
    return (_arms(completions).where(F.col("gendr").isin(*GENDERS_FM))
            .groupBy("variation", "gendr")
            .agg(stable(F.avg("all_steps_dur_min")).alias("avg_min")))


def step_duration_by_arm(durations: DataFrame) -> DataFrame:
    """Mean step seconds per step and arm (first rows, without a duration, skipped)."""
    return (_arms(durations).groupBy("variation", "process_step")
            .agg(stable(F.avg("step_duration_sec")).alias("avg_sec"))
            .withColumn("step_num", step_num("process_step")))


def step_duration_by_age(durations: DataFrame) -> DataFrame:
    """Mean step seconds per left-closed age band x step x arm, F and M only."""
    band = age_band_left_closed(F.col("clnt_age"))
    return (_arms(durations).where(F.col("gendr").isin(*GENDERS_FM) & band.isNotNull())
            .groupBy("variation", "process_step", band.alias("age_band"))
            .agg(stable(F.avg("step_duration_sec")).alias("avg_sec"))
            .withColumn("band_order", band_order(F.col("age_band"), LEFT_CLOSED)))


def step_duration_by_gender(durations: DataFrame) -> DataFrame:
    """Mean step seconds per step x gender x arm, F and M only."""
    return (_arms(durations).where(F.col("gendr").isin(*GENDERS_FM))
            .groupBy("variation", "process_step", "gendr")
            .agg(stable(F.avg("step_duration_sec")).alias("avg_sec")))


def duration_log_distribution(completions: DataFrame,
                              per_decade: int = LOG_BINS_PER_DECADE) -> DataFrame:
    """Total minutes on a log axis: counts per quarter-decade bin and arm, with the
    arm's mean as the reference line."""
    x = F.col("all_steps_dur_min")
    arms = _arms(completions)
    means = arms.groupBy("variation").agg(stable(F.avg(x)).alias("avg_all"))
    bins = (arms.where(x > 0)
            .groupBy("variation", F.floor(F.log10(x) * per_decade).cast("long").alias("log_bin"))
            .agg(F.count("*").alias("n")))
    return bins.join(means, "variation")
