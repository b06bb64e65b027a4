"""Seeded bootstrap intervals for group means.

A replicate of the ordinary bootstrap draws n rows with replacement, which needs all rows in
one place.  In the Poisson bootstrap every row gets a weight of its own, Poisson(1), in every
replicate; a replicate's mean is the ratio of two weighted sums, so all replicates are one
grouped aggregate with map-side partials, and only replicates x groups rows are shuffled.

The weights come from a hash of (row key, replicate) in integer arithmetic modulo a prime, so a
rerun, a retried task or another engine gets the same weights and the same interval.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import stable

REPLICATES = 200
PRIME = 2_147_483_647
#: P(weight <= k) for Poisson(1) in units of 1 / PRIME, for k = 0 to 10; larger weights do not
#: occur in so many draws.
POISSON = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))
           for k in range(11)]


def draw(key: Column, replicate: Column, seed: int = 1) -> Column:
    """A pseudorandom integer below ``PRIME``; every product stays below 2 ** 62."""
    x = (F.pmod(key, F.lit(PRIME)) * 48271 + replicate * 69621 + seed) % PRIME
    y = (x * x + replicate * 16807 + 12345) % PRIME
    x = (y * 39373 + x) % PRIME
    return (x * x + y) % PRIME


def poisson(u: Column) -> Column:
    """The Poisson(1) weight of a draw."""
    return sum((F.when(u >= c, 1).otherwise(0) for c in POISSON[1:]),
               F.when(u >= POISSON[0], 1).otherwise(0))


def replicate_means(df: DataFrame, key: str, by: list[str], values: list[str],
                    replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """``by``, replicate and the weighted mean of each of ``values`` (nulls left out); ``key``
    is a whole-number id of the row.  A replicate in which a group has no weight gives null."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    rows = rows.withColumn("_w", poisson(draw(
        F.col(key).cast("long"), F.col("replicate").cast("long"), seed)))
    sums = []
    for v in values:
        sums += [F.sum(F.col("_w") * F.col(v)).alias(f"_s_{v}"),
                 F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).alias(f"_n_{v}")]
    found = rows.groupBy(*by, "replicate").agg(*sums)
    return found.select(*by, "replicate", *[
        F.try_divide(F.col(f"_s_{v}"), F.col(f"_n_{v}")).alias(v) for v in values])


def intervals(df: DataFrame, key: str, by: list[str], values: list[str], level: float = 0.95,
              replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """``by``, metric, n, mean and the percentile interval of the mean over the replicates
    (interpolated between replicates)."""
    tails = F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))
    means = replicate_means(df, key, by, values, replicates, seed)
    means = means.unpivot([*by, "replicate"], values, "metric", "_m")
    # the metric is the group's last part; a null group key must still meet itself
    drawn = means.groupBy(*by, "metric").agg(F.percentile("_m", tails).alias("_q"))
    own = df.unpivot(by, values, "metric", "_v").groupBy(*by, "metric").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("_mean"))
    same = [own[c].eqNullSafe(drawn[c]) for c in [*by, "metric"]]
    return own.join(drawn, same).select(
        *[own[c] for c in [*by, "metric"]], "n", stable(F.col("_mean")).alias("mean"),
        stable(F.col("_q")[0]).alias("ci_low"), stable(F.col("_q")[1]).alias("ci_high"))
