"""Group-balance checks on assigned clients.

Input: the roster joined with clean demographics, one row per client.  Quantiles use
Spark's exact ``percentile`` (linear interpolation, as pandas ``describe``); its buffer
holds one counter per distinct value, which stays small for age and tenure (a few hundred
distinct values).  ``approx=True`` switches to ``percentile_approx`` for columns whose
distinct values grow with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_half_even, stable

METRICS = ["clnt_age", "clnt_tenure_yr"]
GENDERS = ["F", "M", "U", "X"]
HIST_BINS = 30


def assigned(clients: DataFrame) -> DataFrame:
    """Clients with an arm (the primary population)."""
    return clients.where(F.col("variation").isNotNull())


def long_metrics(clients: DataFrame, *ids: str) -> DataFrame:
    """One row per (client, metric) so all metrics share one aggregate."""
    return assigned(clients).unpivot(["variation", *ids], METRICS, "metric", "value")


def _quantiles(value: str, approx: bool):
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    if approx:
        return F.percentile_approx(value, probs, 10000)
    return F.percentile(value, probs)


def balance_describe(clients: DataFrame, approx: bool = False) -> DataFrame:
    """``describe()`` of age and tenure per arm, rounded to 2 digits."""
    agg = long_metrics(clients).groupBy("variation", "metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        _quantiles("value", approx).alias("_q"),
        F.max("value").alias("max"))
    r = lambda c: round_half_even(c, 2)
    return agg.select(
        "variation", "metric", "count", r(F.col("mean")).alias("mean"),
        r(F.col("std")).alias("std"), r(F.col("min")).alias("min"),
        r(F.col("_q")[0]).alias("q25"), r(F.col("_q")[1]).alias("q50"),
        r(F.col("_q")[2]).alias("q75"), r(F.col("max")).alias("max"))


def gender_crosstab(clients: DataFrame) -> DataFrame:
    """Gender shares (percent of clients with a known gender) per arm."""
    g = F.col("gendr")
    known = assigned(clients).where(g.isNotNull())
    aggs = [F.count("*").alias("_n")] + [F.count(F.when(g == x, 1)).alias(f"_{x}")
                                          for x in GENDERS]
    counts = known.groupBy("variation").agg(*aggs)
    return counts.select("variation", *[(F.col(f"_{x}") / F.col("_n") * 100)
                                        .alias(f"{x.lower()}_pct") for x in GENDERS])


def balance_by_gender(clients: DataFrame, z: float = 1.96) -> DataFrame:
    """Mean age / tenure per arm x gender with a normal 95% interval (the
    reference's bootstrap bars are unseeded, so the closed form replaces them)."""
    agg = (long_metrics(clients, "gendr").where(F.col("gendr").isNotNull())
           .groupBy("variation", "gendr", "metric")
           .agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"),
                F.count("value").alias("n")))
    half = F.lit(z) * F.col("_s") / F.sqrt(F.col("n"))
    return agg.select("variation", "gendr", "metric", "n",
                      stable(F.col("_m")).alias("mean"),
                      stable(F.col("_m") - half).alias("ci_low"),
                      stable(F.col("_m") + half).alias("ci_high"))


def balance_boxplot(clients: DataFrame, approx: bool = False) -> DataFrame:
    """Box-plot statistics per arm x gender x metric: quartiles, 1.5 IQR whiskers
    (most extreme values inside the fences) and the number of outliers.

    The quartiles (one row per group) are joined back to the values; AQE broadcasts them
    at run time because the measured side is tiny.
    """
    vals = long_metrics(clients, "gendr").where(
        F.col("gendr").isNotNull() & F.col("value").isNotNull())
    keys = ["variation", "gendr", "metric"]
    q = vals.groupBy(*keys).agg(_quantiles("value", approx).alias("_q")).select(
        *keys, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"),
        F.col("_q")[2].alias("q75"))
    iqr = F.col("q75") - F.col("q25")
    lo_fence = F.col("q25") - F.lit(1.5) * iqr
    hi_fence = F.col("q75") + F.lit(1.5) * iqr
    v = F.col("value")
    inside = (v >= lo_fence) & (v <= hi_fence)
    out = vals.join(q, keys).groupBy(*keys, "q25", "q50", "q75").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))
    return out.select(*keys, *[stable(F.col(c)).alias(c) for c in
                               ("q25", "q50", "q75", "whisker_low", "whisker_high")],
                      "n_outliers")


def histogram(clients: DataFrame, metric: str, bins: int = HIST_BINS) -> DataFrame:
    """Per-arm histogram over the arm's own [min, max] with ``bins`` equal bins,
    bin edges and assignment as in ``numpy.histogram`` (the max falls in the last bin);
    empty bins are reported with n = 0."""
    vals = assigned(clients).select("variation", F.col(metric).alias("x")).where(
        F.col("x").isNotNull())
    rng = vals.groupBy("variation").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    same = F.col("_lo") == F.col("_hi")
    rng = rng.select(
        "variation",
        F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(bins)

    def edge(i):
        return F.when(i >= bins, F.col("_hi")).otherwise(i * step + F.col("_lo"))

    x = F.col("x")
    first = F.floor((x - F.col("_lo")) * (F.lit(bins) / (F.col("_hi") - F.col("_lo"))))
    first = F.least(F.greatest(first, F.lit(0)), F.lit(bins - 1)).cast("int")
    b = F.when(x < edge(first), first - 1).when(
        (x >= edge(first + 1)) & (first != bins - 1), first + 1).otherwise(first)
    counts = vals.join(rng, "variation").groupBy("variation", b.alias("bin")).agg(
        F.count("*").alias("n"))
    grid = rng.select("variation", "_lo", "_hi",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    i = F.col("bin")
    return (grid.join(counts, ["variation", "bin"], "left")
            .select("variation", "bin", stable(edge(i)).alias("lo"),
                    stable(edge(i + 1)).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def age_tenure_relation(clients: DataFrame) -> DataFrame:
    """Pearson correlation of age and tenure per arm (the pair plot's summary)."""
    return assigned(clients).groupBy("variation").agg(
        F.count(F.when(F.col("clnt_age").isNotNull() & F.col("clnt_tenure_yr").isNotNull(), 1))
        .alias("n"),
        stable(F.corr("clnt_age", "clnt_tenure_yr")).alias("corr"))


AGE_BIN_YEARS = 10
TENURE_BIN_YEARS = 5


def age_tenure_bins(clients: DataFrame, age_step: int = AGE_BIN_YEARS,
                    tenure_step: int = TENURE_BIN_YEARS) -> DataFrame:
    """The pair plot's joint distribution as 2-D binned counts per arm (lower bin
    edges of age and tenure)."""
    age_lo = (F.floor(F.col("clnt_age") / age_step) * age_step).cast("long")
    ten_lo = (F.floor(F.col("clnt_tenure_yr") / tenure_step) * tenure_step).cast("long")
    return (assigned(clients)
            .where(F.col("clnt_age").isNotNull() & F.col("clnt_tenure_yr").isNotNull())
            .groupBy("variation", age_lo.alias("age_bin"), ten_lo.alias("tenure_bin"))
            .agg(F.count("*").alias("n")))


GRID, CUT = 128, 3


def density(clients: DataFrame, grid: int = GRID, cut: float = CUT) -> DataFrame:
    """The pair plot's diagonal, a Gaussian kernel density per arm of age and tenure.

    Scott's bandwidth (standard deviation x n ** -0.2) per arm; values are shared between the
    two nearest of ``grid`` points from ``cut`` bandwidths below the least value to as many
    above the largest, and the kernel is summed over the points' shares, so the work behind
    the passes over the clients does not depend on their number.  Arms with one distinct
    value, or none, have no density.
    """
    keys = ["variation", "metric"]
    vals = long_metrics(clients).where(F.col("value").isNotNull())
    own = vals.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        stable(F.stddev_samp("value") * F.pow(F.count("*").cast("double"), F.lit(-0.2)))
        .alias("bandwidth")).where(F.col("bandwidth") > 0)
    own = own.withColumns({"_lo": stable(F.col("_lo") - cut * F.col("bandwidth")),
                           "_hi": stable(F.col("_hi") + cut * F.col("bandwidth"))})
    own = own.withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(grid - 1)))
    at = (F.col("value") - F.col("_lo")) / F.col("_step")
    below = F.floor(at).cast("int")
    shares = F.array(F.struct(below.alias("_bin"), (1 - (at - below)).alias("_w")),
                     F.struct((below + 1).alias("_bin"), (at - below).alias("_w")))
    counts = (vals.join(own, keys).select(*keys, F.inline(shares)).groupBy(*keys, "_bin")
              .agg(F.sum("_w").alias("_c")))
    points = own.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    # at most grid x grid rows per arm and metric
    z = (F.col("point") - F.col("_bin")) * F.col("_step") / F.col("bandwidth")
    kernel = F.exp(F.lit(-0.5) * z * z) * F.col("_c")
    x = F.col("_lo") + F.col("point") * F.col("_step")
    scale = F.col("n") * F.col("bandwidth") * F.lit((2 * math.pi) ** 0.5)
    summed = points.join(counts, keys).groupBy(
        *keys, "point", "n", "bandwidth", x.alias("x"), scale.alias("_scale")).agg(
        F.sum(kernel).alias("_k"))
    return summed.select(*keys, "point", stable("x").alias("x"), "n", "bandwidth",
                         stable(F.col("_k") / F.col("_scale"), 9).alias("density"))
