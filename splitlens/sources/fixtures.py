"""Derive the experiment's domain tables from the driver's parquet tables.

The reference ships no raw inputs, so the web log parts, the experiment roster and the
demographics are derived from ``events`` and ``customer`` with the mapping rules of
FIXTURES.md section 3.  The derivation is a projection plus filters, so Catalyst prunes
the parquet scan to the columns used and pushes the filters into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type -> funnel step used by the fixture mapping.
EVENT_TO_STEP = {
    "view": "start",
    "click": "step_1",
    "signup": "step_2",
    "error": "step_3",
    "purchase": "confirm",
}
VISIT_EPOCH = "2024-01-01 00:00:00"
VISIT_BUCKET_SECONDS = 432000  # five days
VISIT_BUCKET_OFFSET = 7

WEB_COLUMNS = ["client_id", "visitor_id", "visit_id", "process_step", "date_time", "event_seq"]


@dataclass(frozen=True)
class Domain:
    web_pt1: DataFrame
    web_pt2: DataFrame
    experiment: DataFrame
    demographics: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _step_of(event_type: Column) -> Column:
    expr = None
    for ev, step in EVENT_TO_STEP.items():
        expr = F.when(event_type == ev, step) if expr is None else expr.when(event_type == ev, step)
    return expr


def web_events(events: DataFrame) -> DataFrame:
    """Base event rows in the web-log shape (all events but some clients' purchases)."""
    epoch = F.lit(VISIT_EPOCH).cast("timestamp_ntz")
    secs = F.timestamp_diff("SECOND", epoch, F.col("ts"))
    # integral division: the 5-day bucket of the event, numbered from 7
    bucket = (secs - F.pmod(secs, F.lit(VISIT_BUCKET_SECONDS))) / F.lit(VISIT_BUCKET_SECONDS)
    bucket = bucket.cast("long") + F.lit(VISIT_BUCKET_OFFSET)
    uid = F.col("user_id").cast("string")
    return (
        events.where(~((F.col("event_type") == "purchase") & (F.col("user_id") % 4 == 1)))
        .select(
            F.col("user_id").cast("long").alias("client_id"),
            F.concat(uid, F.lit("_"),
                     F.when(F.col("event_id") % 10 == 0, F.lit("1")).otherwise(F.lit("0"))
                     ).alias("visitor_id"),
            F.concat(uid, F.lit("_"), bucket.cast("string")).alias("visit_id"),
            _step_of(F.col("event_type")).alias("process_step"),
            # whole seconds, computed on TIMESTAMP_NTZ so no session time zone is involved
            F.timestamp_add("SECOND", secs, epoch).alias("date_time"),
            F.col("event_id").cast("long").alias("event_seq"),
        )
    )


def load_domain(spark: SparkSession, sf_dir: str) -> Domain:
    events = read_table(spark, sf_dir, "events")
    customer = read_table(spark, sf_dir, "customer")
    ev = web_events(events)
    seq = F.col("event_seq")
    web_pt1 = ev.where(seq % 2 == 0).unionByName(ev.where(seq % 50 == 0))
    web_pt2 = (ev.where(seq % 2 == 1)
               .unionByName(ev.where(seq % 50 == 25))
               .unionByName(ev.where(seq % 98 == 0)))

    key = F.col("c_custkey").cast("long")
    arm = key % 5
    experiment = customer.where(key % 11 != 10).select(
        key.alias("client_id"),
        F.when(arm.isin(0, 1), F.lit("Control")).when(arm.isin(2, 3), F.lit("Test"))
        .alias("variation"),
    )
    demographics = customer.where(key % 29 != 28).select(
        key.alias("client_id"),
        F.when(key % 37 == 5, F.lit(None))
        .otherwise((F.lit(2) + key % 30).cast("double")).alias("clnt_tenure_yr"),
        F.when(key % 41 == 7, F.lit(None))
        .otherwise((F.lit(18) + (key * 7) % 60).cast("double")
                   + F.lit(0.5) * (key % 2).cast("double")).alias("clnt_age"),
        F.when(key % 53 == 3, F.lit("X"))
        .when(key % 3 == 0, F.lit("F"))
        .when(key % 3 == 1, F.lit("M"))
        .otherwise(F.lit("U")).alias("gendr"),
        F.col("c_acctbal").cast("double").alias("bal"),
    )
    return Domain(web_pt1, web_pt2, experiment, demographics)
