"""Rounding that agrees with NumPy ``round``: round half to even on the scaled float.

``x.round(k)`` in pandas is ``rint(x * 10**k) / 10**k``; Spark's ``round`` is half-up,
so the reference's numbers are reproduced with ``rint`` instead (SURVEY T14).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(col: Column | str, digits: int) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.rint(col.cast("double") * F.lit(scale)) / F.lit(scale)


def round_half_even_sql(expr: str, digits: int) -> str:
    scale = f"{float(10 ** digits)!r}"
    return f"(CAST(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) AS DOUBLE) / {scale})"


def stable(col: Column | str, digits: int = 6) -> Column:
    """Round a derived statistic to ``digits`` so engines with different summation
    orders report the same value."""
    return round_half_even(col, digits)


def stable_sql(expr: str, digits: int = 6) -> str:
    return round_half_even_sql(expr, digits)
