"""Age bands of the dashboards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band labels and their display order.
RIGHT_CLOSED = [("<=30", 1), ("30-50", 2), ("50-60", 3), (">60", 4)]
LEFT_CLOSED = [("<30", 1), ("30-50", 2), ("50-60", 3), (">=60", 4)]


def age_band_right_closed(age: Column) -> Column:
    """P20: <=30, (30, 50], (50, 60], >60."""
    return (F.when(age <= 30, "<=30").when(age <= 50, "30-50").when(age <= 60, "50-60")
            .when(age > 60, ">60"))


def age_band_left_closed(age: Column) -> Column:
    """<30, [30, 50), [50, 60), >=60."""
    return (F.when(age < 30, "<30").when(age < 50, "30-50").when(age < 60, "50-60")
            .when(age >= 60, ">=60"))


def band_order(band: Column, bands) -> Column:
    """The manual sort key of a band label."""
    expr = None
    for label, pos in bands:
        expr = F.when(band == label, pos) if expr is None else expr.when(band == label, pos)
    return expr
