"""Mergeable sketches for counts and quantiles that are rolled up many ways (SURVEY A2, A10,
A11, A17, A19, A28, D7).

Exact distinct counts keep every (group, client) pair through a shuffle, and exact quantiles
keep every distinct value of a group in one buffer.  The sketches here have a fixed size per
group, are built by partial aggregates, stored per arm, step and day, and merged for any
coarser grain without reading the events again.  The exact operators stay the default; the
bounds below say what the sketches give up.

* Distinct clients: theta sketches of ``2 ** LG_ENTRIES`` hashes.  Counts up to that number are
  exact; above it the relative standard error is ``1 / sqrt(2 ** LG_ENTRIES - 1)`` (1.6 %).
  Unions and intersections are sketches too.
* Quantiles: KLL sketches with parameter ``KLL_K``.  The value returned for a share p has a true
  rank within ``KLL_RANK_ERROR`` of p (at 99 % confidence), whatever the values; groups of up
  to ``KLL_K`` values are exact.  The quantile is the inclusive one: the least value with at
  least the share p of the values at or below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_half_even
from ..functions.steps import ARMS, STEPS

LG_ENTRIES = 12
THETA_ERROR = 3 / (2 ** LG_ENTRIES - 1) ** 0.5  # three standard errors
KLL_K = 4096
KLL_RANK_ERROR = 2.446 / KLL_K ** 0.9433  # the sketch's published two-sided bound
PROBS = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}


# -- distinct clients -----------------------------------------------------------------------
def client_sketches(events: DataFrame, *by: str) -> DataFrame:
    """One theta sketch of the clients per ``by`` and day; rows without a client or a time are
    left out, null groups are groups of their own."""
    known = events.where(F.col("client_id").isNotNull() & F.col("date_time").isNotNull())
    return (known.withColumn("day", F.col("date_time").cast("date").cast("string"))
            .groupBy(*by, "day")
            .agg(F.theta_sketch_agg("client_id", LG_ENTRIES).alias("clients")))


def rolled_up(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches' unions per ``by``: a client seen on several days counts once."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("clients", LG_ENTRIES).alias("clients"))


def estimate(sketches: DataFrame, name: str) -> DataFrame:
    return sketches.withColumn(name, F.theta_sketch_estimate("clients")).drop("clients")


def step_clients(sketches: DataFrame) -> DataFrame:
    """A17 from sketches by arm and step: clients per known step."""
    known = sketches.where(F.col("process_step").isin(*STEPS))
    return estimate(rolled_up(known, "variation", "process_step"), "n_clients")


def daily_clients(sketches: DataFrame) -> DataFrame:
    """Clients per arm and day, over all steps."""
    return estimate(rolled_up(sketches, "variation", "day"), "n_clients")


def finisher_rate(sketches: DataFrame) -> DataFrame:
    """A10-A12 from sketches by arm and finish flag: arms without a finisher have no row."""
    arms = sketches.where(F.col("variation").isin(*ARMS))
    total = estimate(rolled_up(arms, "variation"), "total_clients")
    done = estimate(rolled_up(arms.where("finish"), "variation"), "clients_finished")
    share = F.col("clients_finished") / F.col("total_clients") * 100
    return done.join(total, "variation").select(
        "variation", "clients_finished", "total_clients",
        round_half_even(share, 2).alias("finisher_clients_pct"))


def arm_overlap(sketches: DataFrame) -> DataFrame:
    """Clients in both arms, from the intersection of the arms' sketches (two of a few
    bytes, so one row each)."""
    arms = [rolled_up(sketches.where(F.col("variation") == a)).select(F.col("clients").alias(a))
            for a in ARMS]
    one, other = (a.scalar() for a in arms)
    both = F.theta_sketch_estimate(F.theta_intersection(one, other))
    spark = sketches.sparkSession
    return spark.range(1).select(F.coalesce(both, F.lit(0)).alias("n_overlap"))


# -- quantiles ------------------------------------------------------------------------------
def value_sketches(df: DataFrame, value: str, *by: str) -> DataFrame:
    """One KLL sketch of the non-null values per ``by``."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("sketch"))


def merged_values(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(KLL_K)).alias("sketch"))


def quantiles(sketches: DataFrame) -> DataFrame:
    """``n`` and the quantiles of ``PROBS`` of every sketch."""
    probs = F.array(*map(F.lit, PROBS.values()))
    found = sketches.withColumns({"n": F.kll_sketch_get_n_double("sketch"),
                                  "_q": F.kll_sketch_get_quantile_double("sketch", probs)})
    named = {name: F.col("_q")[i] for i, name in enumerate(PROBS)}
    return found.withColumns(named).drop("sketch", "_q")
