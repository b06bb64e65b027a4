"""Normal and Student-t tail probabilities as JVM-side column expressions.

Spark SQL has neither ``erf`` nor an incomplete beta function, so both are written with
built-in arithmetic: the normal tail with the double-precision rational approximation of
Hart (1968, algorithm 5666, as published by West 2005), the Student-t distribution
through the regularised incomplete beta function evaluated with Lentz's continued
fraction inside the ``aggregate`` higher-order function, and log-gamma with the Lanczos
approximation.  The same formulas are also rendered as SQL text for the oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart 5666 coefficients (published constants).
_HART_NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
             112.079291497871, 221.213596169931, 220.206867912376]
_HART_DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
             296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
_HART_SWITCH = 7.07106781186547
_SQRT_2PI = 2.506628274631

# Lanczos coefficients, g = 7, n = 9 (published constants).
_LANCZOS_G = 7.0
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028,
            771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

CF_TERMS = 200          # base number of continued-fraction steps ...
CF_TERMS_PER_ROOT = 8   # ... plus this many per sqrt(max(a, b)); convergence needs O(sqrt)
_FPMIN = 1e-300


def _horner(x, coeffs):
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_lower_tail_abs(x_abs: Column) -> Column:
    """P(Z > |x|) for a non-negative column ``x_abs``."""
    e = F.exp(-(x_abs * x_abs) / F.lit(2.0))
    near = e * _horner(x_abs, _HART_NUM) / _horner(x_abs, _HART_DEN)
    far = x_abs + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        far = x_abs + F.lit(k) / far
    far = e / far / F.lit(_SQRT_2PI)
    return (F.when(x_abs > 37, F.lit(0.0))
            .when(x_abs < _HART_SWITCH, near).otherwise(far))


def norm_sf(z: Column) -> Column:
    """Upper tail 1 - Phi(z), accurate in both tails."""
    tail = normal_lower_tail_abs(F.abs(z))
    return F.when(z.isNull(), F.lit(None)).when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def _horner_sql(x: str, coeffs) -> str:
    acc = repr(coeffs[0])
    for c in coeffs[1:]:
        acc = f"({acc}) * {x} + {c!r}"
    return acc


def norm_sf_sql(z: str) -> str:
    a = f"abs({z})"
    e = f"exp(-({a} * {a}) / 2.0)"
    near = f"({e} * ({_horner_sql(a, _HART_NUM)}) / ({_horner_sql(a, _HART_DEN)}))"
    far = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        far = f"({a} + {k!r} / {far})"
    far = f"({e} / {far} / {_SQRT_2PI!r})"
    tail = (f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {_HART_SWITCH!r} THEN {near} "
            f"ELSE {far} END)")
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN {tail} ELSE 1.0 - {tail} END)"


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0.5 (Lanczos); enough for Student-t with df >= 1."""
    xm = x - F.lit(1.0)
    acc = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        acc = acc + F.lit(c) / (xm + F.lit(float(i)))
    t = xm + F.lit(_LANCZOS_G + 0.5)
    return (F.lit(0.5 * math.log(2 * math.pi)) + (xm + F.lit(0.5)) * F.log(t) - t
            + F.log(acc))


def _betacf(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    qab, qap, qam = a + b, a + F.lit(1.0), a - F.lit(1.0)

    def tiny(v):
        return F.when(F.abs(v) < _FPMIN, F.lit(_FPMIN)).otherwise(v)

    d0 = F.lit(1.0) / tiny(F.lit(1.0) - qab * x / qap)
    zero = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(acc, m):
        m = m.cast("double")
        m2 = m * 2
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = F.lit(1.0) / tiny(F.lit(1.0) + aa * acc["d"])
        c = tiny(F.lit(1.0) + aa / acc["c"])
        h = acc["h"] * d * c
        aa2 = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d2 = F.lit(1.0) / tiny(F.lit(1.0) + aa2 * d)
        c2 = tiny(F.lit(1.0) + aa2 / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

    n = (F.lit(CF_TERMS) + F.lit(CF_TERMS_PER_ROOT)
         * F.ceil(F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda acc: acc["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) for 0 <= x <= 1."""
    bt = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x)
               + b * F.log(F.lit(1.0) - x))
    direct = bt * _betacf(a, b, x) / a
    mirrored = F.lit(1.0) - bt * _betacf(b, a, F.lit(1.0) - x) / b
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
            .when(x < (a + F.lit(1.0)) / (a + b + F.lit(2.0)), direct).otherwise(mirrored))


def student_t_cdf(t: Column, df: Column, x: Column | None = None,
                  half_df: Column | None = None) -> Column:
    """P(T <= t) for Student's t with (possibly fractional) ``df`` degrees of freedom.

    ``x = df / (df + t^2)`` and ``half_df = df / 2`` may be passed as precomputed columns
    so the (large) continued-fraction expression refers to plain columns.
    """
    x = df / (df + t * t) if x is None else x
    half_df = df / 2 if half_df is None else half_df
    half_tail = F.lit(0.5) * incomplete_beta(half_df, F.lit(0.5), x)
    return (F.when(t.isNull() | df.isNull(), F.lit(None))
            .when(t < 0, half_tail).otherwise(F.lit(1.0) - half_tail))


# -- SQL twins (DuckDB dialect) used by the oracle ----------------------------------------
def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def lgamma_sql(x: str) -> str:
    xm = f"({x} - 1.0e0)"
    acc = _d(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        acc = f"({acc} + {_d(c)} / ({xm} + {_d(i)}))"
    t = f"({xm} + {_d(_LANCZOS_G + 0.5)})"
    return (f"({_d(0.5 * math.log(2 * math.pi))} + ({xm} + 0.5e0) * ln({t}) - {t} "
            f"+ ln({acc}))")


def _betacf_sql(a: str, b: str, x: str) -> str:
    qab, qap, qam = f"({a} + {b})", f"({a} + 1.0e0)", f"({a} - 1.0e0)"

    def tiny(v: str) -> str:
        return f"(CASE WHEN abs({v}) < {_FPMIN!r} THEN {_FPMIN!r} ELSE {v} END)"

    d0 = f"(1.0e0 / {tiny(f'(1.0e0 - {qab} * {x} / {qap})')})"
    m = "CAST(m AS DOUBLE)"
    m2 = f"({m} * 2)"
    aa = f"({m} * ({b} - {m}) * {x} / (({qam} + {m2}) * ({a} + {m2})))"
    d = f"(1.0e0 / {tiny(f'(1.0e0 + {aa} * acc.d)')})"
    c = tiny(f"(1.0e0 + {aa} / acc.c)")
    h = f"(acc.h * {d} * {c})"
    aa2 = f"(-({a} + {m}) * ({qab} + {m}) * {x} / (({a} + {m2}) * ({qap} + {m2})))"
    d2 = f"(1.0e0 / {tiny(f'(1.0e0 + {aa2} * {d})')})"
    c2 = tiny(f"(1.0e0 + {aa2} / {c})")
    step = f"{{'c': {c2}, 'd': {d2}, 'h': {h} * {d2} * {c2}}}"
    zero = f"{{'c': 1.0e0, 'd': {d0}, 'h': {d0}}}"
    n = f"({CF_TERMS} + {CF_TERMS_PER_ROOT} * CAST(ceil(sqrt(greatest({a}, {b}))) AS INTEGER))"
    return f"(list_reduce(range(1, {n} + 1), lambda acc, m: {step}, {zero}).h)"


def incomplete_beta_sql(a: str, b: str, x: str) -> str:
    bt = (f"exp({lgamma_sql(f'({a} + {b})')} - {lgamma_sql(a)} - {lgamma_sql(b)} "
          f"+ {a} * ln({x}) + {b} * ln(1.0e0 - {x}))")
    direct = f"({bt} * {_betacf_sql(a, b, x)} / {a})"
    mirrored = f"(1.0e0 - {bt} * {_betacf_sql(b, a, f'(1.0e0 - {x})')} / {b})"
    return (f"(CASE WHEN {x} <= 0 THEN 0.0e0 WHEN {x} >= 1 THEN 1.0e0 "
            f"WHEN {x} < ({a} + 1.0e0) / ({a} + {b} + 2.0e0) THEN {direct} ELSE {mirrored} END)")


def student_t_cdf_sql(t: str, df: str) -> str:
    x = f"({df} / ({df} + {t} * {t}))"
    half = f"(0.5e0 * {incomplete_beta_sql(f'({df} / 2)', '0.5e0', x)})"
    return (f"(CASE WHEN {t} IS NULL OR {df} IS NULL THEN NULL WHEN {t} < 0 THEN {half} "
            f"ELSE 1.0e0 - {half} END)")
