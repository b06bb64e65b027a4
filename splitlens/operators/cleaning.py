"""Cleaning, deduplication and the client-keyed joins.

Joins against the per-client tables (experiment roster, demographics) carry no broadcast
hint: Catalyst broadcasts them only when its size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans with the measured size, so the
roster is broadcast while it is small and falls back to a shuffled join when it is not.
A client holding a large share of the events is split by AQE's skew-join handling, which
only works for the preserved side of an outer join; the operators below therefore keep
the event table on the splittable side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import stable
from ..functions.steps import ARMS, UNASSIGNED_LABEL
from .joins import full_outer

DEMO_COLUMNS = ["client_id", "clnt_tenure_yr", "clnt_age", "gendr", "bal"]
EVENT_COLUMNS = ["variation", "visitor_id", "visit_id", "process_step", "date_time", "event_seq"]


def web_log_clean(pt1: DataFrame, pt2: DataFrame) -> DataFrame:
    """Exact-row dedupe of each part, then UNION ALL.

    Duplicates across the two parts survive on purpose (SURVEY T3); deduping after the
    union would drop them.  ``dropDuplicates`` plans a partial (map-side) aggregate, so
    a row repeated many times is collapsed before the shuffle.
    """
    return pt1.dropDuplicates().unionByName(pt2.dropDuplicates())


def web_with_groups(web: DataFrame, experiment: DataFrame) -> DataFrame:
    """Inner join on client_id; clients listed with a null arm are kept."""
    return experiment.join(web, "client_id", "inner").select(
        "client_id", "variation", "visitor_id", "visit_id", "process_step", "date_time",
        "event_seq")


def demo_clean(demographics: DataFrame) -> DataFrame:
    """Drop rows without tenure, impute a missing age with the mean age of the
    female clients that remain (P6, P9).

    The mean is a scalar subquery (one global partial aggregate, evaluated once and
    shipped to the tasks as a value), so no join is involved.
    """
    kept = demographics.where(F.col("clnt_tenure_yr").isNotNull())
    mean_f = kept.where(F.col("gendr") == "F").agg(F.avg("clnt_age")).scalar()
    return kept.withColumn("clnt_age", F.coalesce(F.col("clnt_age"), mean_f))


def master(demo: DataFrame, web_groups: DataFrame) -> DataFrame:
    """Full outer join of clean demographics and the grouped web log (USING key), with hot
    clients split on either side."""
    return full_outer(demo, web_groups, "client_id").select(*DEMO_COLUMNS, *EVENT_COLUMNS)


def with_demographics(demo: DataFrame, web_groups: DataFrame) -> DataFrame:
    """Rows of ``master`` whose demographics side is present.

    Clean demographics never carry a null age, so "age present" is exactly the rows with a
    demographics match.  This is written as an inner join (skew-splittable on both sides)
    plus the demographics-only clients found by an anti join against the distinct web
    clients, instead of a full outer join whose skewed side could not be split.
    """
    matched = web_groups.join(demo, "client_id", "inner")
    web_clients = web_groups.select("client_id").distinct()
    demo_only = demo.join(web_clients, "client_id", "left_anti")
    for name, dtype in web_groups.dtypes:
        if name != "client_id":
            demo_only = demo_only.withColumn(name, F.lit(None).cast(dtype))
    cols = [*DEMO_COLUMNS, *EVENT_COLUMNS]
    return matched.select(*cols).unionByName(demo_only.select(*cols))


def merged_events(demo: DataFrame, web_groups: DataFrame) -> DataFrame:
    """The merge used by the duration and funnel family: age present, all genders,
    unassigned arm labelled ``Others`` (P3, P6, P8)."""
    return with_demographics(demo, web_groups).withColumn(
        "variation", F.coalesce(F.col("variation"), F.lit(UNASSIGNED_LABEL)))


def kpi_population(demo: DataFrame, web_groups: DataFrame) -> DataFrame:
    """P6 + P7: age present, gender not 'X' (null gender kept, SURVEY T2)."""
    return with_demographics(demo.where(~F.col("gendr").eqNullSafe("X")), web_groups)


def valid_groups(df: DataFrame, exclude_gender_x: bool = True) -> DataFrame:
    """P5: keep Control/Test rows, optionally dropping gender 'X' (null-safe)."""
    out = df.where(F.col("variation").isin(*ARMS))
    if exclude_gender_x:
        out = out.where(~F.col("gendr").eqNullSafe("X"))
    return out


def assigned_clients(experiment: DataFrame, demo: DataFrame) -> DataFrame:
    """Roster joined with clean demographics, one row per client."""
    return experiment.join(demo, "client_id", "inner")


def group_labels(experiment: DataFrame, demo: DataFrame) -> DataFrame:
    """Label the unassigned arm ``no_data`` and profile each label."""
    labelled = assigned_clients(experiment, demo).withColumn(
        "label", F.coalesce(F.col("variation"), F.lit("no_data")))
    return labelled.groupBy("label").agg(
        F.count("*").alias("n_clients"),
        stable(F.avg("clnt_age")).alias("avg_age"),
        stable(F.avg("clnt_tenure_yr")).alias("avg_tenure"))


def group_fold_sensitivity(experiment: DataFrame, demo: DataFrame) -> DataFrame:
    """The sensitivity population that folds unassigned clients into Control."""
    folded = assigned_clients(experiment, demo).withColumn(
        "label", F.when(F.col("variation").isNull() | (F.col("variation") == "Control"),
                        F.lit("Control")).otherwise(F.lit("Test")))
    return folded.groupBy("label").agg(
        F.count("*").alias("n_clients"),
        stable(F.avg("clnt_age")).alias("avg_age"),
        stable(F.avg("clnt_tenure_yr")).alias("avg_tenure"))
