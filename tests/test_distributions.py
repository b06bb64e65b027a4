"""Normal and Student-t tails against independent numerics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitlens.functions.distributions import norm_sf, student_t_cdf


def t_cdf_numeric(t, df):
    """P(T <= t) by integrating the density on a fine grid (independent check)."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    lo = min(t, 0.0) - 0.0
    x = np.linspace(-abs(t), abs(t), 200001) if t != 0 else np.array([0.0])
    dens = c * (1 + x * x / df) ** (-(df + 1) / 2)
    central = np.trapezoid(dens, x) if t != 0 else 0.0
    return 0.5 + math.copysign(central / 2, t) + 0 * lo


@pytest.mark.parametrize("z", [-3.0, -1.2, 0.0, 0.5, 1.6448536269514722, 2.5, 8.0, 13.1564])
def test_norm_sf(spark, z):
    got = spark.range(1).select(norm_sf(F.lit(z)).alias("p")).first().p
    want = 0.5 * math.erfc(z / math.sqrt(2))
    assert got == pytest.approx(want, rel=1e-12 if abs(z) < 7 else 1e-7, abs=1e-300)


@pytest.mark.parametrize("t,df", [(-2.0, 3.0), (0.5, 7.5), (-0.3, 30.0), (1.7, 1000.0),
                                  (-4.0, 12.3), (2.2, 1.5)])
def test_student_t_cdf(spark, t, df):
    got = spark.range(1).select(student_t_cdf(F.lit(t), F.lit(df)).alias("p")).first().p
    assert got == pytest.approx(t_cdf_numeric(t, df), abs=1e-8)


@pytest.mark.parametrize("t,df", [(-2.5, 2.0e6), (1.9, 5.0e5)])
def test_student_t_cdf_large_df_is_normal(spark, t, df):
    got = spark.range(1).select(student_t_cdf(F.lit(t), F.lit(df)).alias("p")).first().p
    assert got == pytest.approx(0.5 * math.erfc(-t / math.sqrt(2)), rel=1e-5)
