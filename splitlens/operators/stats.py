"""One-sided significance tests.

Counts come from one aggregate over the event table; the statistics are column
expressions over the resulting one-row table, so only that row ever reaches the driver.
A missing arm yields null statistics instead of a division error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import norm_sf, student_t_cdf
from ..functions.rounding import stable
from .kpis import _arms, arm_totals

ALPHA = 0.05


def _arm(col: str, arm: str) -> Column:
    return F.max(F.when(F.col("variation") == arm, F.col(col)))


def two_proportion_ztest(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Pooled one-sided z-test of H1: p_test > p_control on a table with columns
    ``variation``, ``x`` (successes) and ``n`` (trials)."""
    one = counts.agg(_arm("x", "Test").alias("x_test"), _arm("x", "Control").alias("x_control"),
                     _arm("n", "Test").alias("n_test"), _arm("n", "Control").alias("n_control"))
    p_t = F.try_divide(F.col("x_test"), F.col("n_test"))
    p_c = F.try_divide(F.col("x_control"), F.col("n_control"))
    pooled = F.try_divide(F.col("x_test") + F.col("x_control"),
                          F.col("n_test") + F.col("n_control"))
    se = F.sqrt(pooled * (F.lit(1) - pooled)
                * (F.try_divide(F.lit(1.0), F.col("n_test"))
                   + F.try_divide(F.lit(1.0), F.col("n_control"))))
    # two projections: the tail formula refers to z many times, so z is a column first
    stat = one.select("n_test", "n_control", "x_test", "x_control", p_t.alias("_pt"),
                      p_c.alias("_pc"), F.try_divide(p_t - p_c, se).alias("_z"))
    p = norm_sf(F.col("_z"))
    return stat.select(
        "n_test", "n_control", "x_test", "x_control",
        stable(F.col("_pt")).alias("p_test"), stable(F.col("_pc")).alias("p_control"),
        stable(F.col("_z")).alias("z_stat"), stable(p).alias("p_value"),
        (p < F.lit(alpha)).alias("reject_h0"))


def ztest_completion(events: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """H1: finishing clients over clients, Test greater than Control."""
    totals = arm_totals(events).select(
        "variation", F.col("clients_finished").alias("x"), F.col("total_clients").alias("n"))
    return two_proportion_ztest(totals, alpha)


def ztest_error_rate(events: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Flagged errors over step rows 1-4, Test greater than Control.
    (The numerator counts errors on all steps, as the reference does; step 0 can never
    be the origin of a backward move.)"""
    counts = _arms(events).groupBy("variation").agg(
        F.count_if(F.coalesce(F.col("is_error"), F.lit(False))).alias("x"),
        F.count_if(F.col("step_num").isin(1, 2, 3, 4)).alias("n"))
    return two_proportion_ztest(counts, alpha)


def welch_inputs(completions: DataFrame, value: str = "all_steps_dur_hr") -> DataFrame:
    return _arms(completions).groupBy("variation").agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def welch_duration(completions: DataFrame, value: str = "all_steps_dur_hr") -> DataFrame:
    """H3 statistics: Welch's t of Test minus Control and the Welch-Satterthwaite df."""
    one = welch_inputs(completions, value).agg(
        *[_arm(c, arm).alias(f"{c}_{arm.lower()}") for arm in ("Test", "Control")
          for c in ("n", "m", "v")])
    se_t = F.try_divide(F.col("v_test"), F.col("n_test"))
    se_c = F.try_divide(F.col("v_control"), F.col("n_control"))
    t = F.try_divide(F.col("m_test") - F.col("m_control"), F.sqrt(se_t + se_c))
    dof = F.try_divide((se_t + se_c) * (se_t + se_c),
                       F.try_divide(se_t * se_t, F.col("n_test") - 1)
                       + F.try_divide(se_c * se_c, F.col("n_control") - 1))
    return one.select(
        F.col("n_test"), F.col("n_control"),
        stable(F.col("m_test")).alias("mean_test"), stable(F.col("m_control")).alias("mean_control"),
        stable(F.col("v_test")).alias("var_test"), stable(F.col("v_control")).alias("var_control"),
        t.alias("_t"), dof.alias("_df"))


def welch_duration_test(completions: DataFrame, alpha: float = ALPHA,
                        value: str = "all_steps_dur_hr") -> DataFrame:
    """H3: one-sided Welch t-test, H1: mean_test < mean_control (lower tail)."""
    base = welch_duration(completions, value)
    base = base.withColumns({"_x": F.col("_df") / (F.col("_df") + F.col("_t") * F.col("_t")),
                             "_a": F.col("_df") / 2})
    p = student_t_cdf(F.col("_t"), F.col("_df"), F.col("_x"), F.col("_a"))
    return base.select(
        "n_test", "n_control", "mean_test", "mean_control", "var_test", "var_control",
        stable(F.col("_t")).alias("t_stat"), stable(F.col("_df")).alias("df"),
        stable(p).alias("p_value"), (p < F.lit(alpha)).alias("reject_h0"))


def welch_statistics(completions: DataFrame, value: str = "all_steps_dur_hr") -> DataFrame:
    return welch_duration(completions, value).select(
        "n_test", "n_control", "mean_test", "mean_control", "var_test", "var_control",
        stable(F.col("_t")).alias("t_stat"), stable(F.col("_df")).alias("df"))


def arm_overlap(events: DataFrame) -> DataFrame:
    """Clients seen in both arms (must be 0 for independent samples)."""
    ids = lambda arm: events.where(F.col("variation") == arm).select("client_id")
    return ids("Control").intersect(ids("Test")).agg(F.count("*").alias("n_overlap"))
