"""Searches in sorted arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_below(cuts: Column, x: Column, most: int, or_equal: bool = False) -> Column:
    """How many of the ascending ``cuts`` (at most ``most`` of them) lie below ``x``, or with
    ``or_equal`` not above it, by binary search: an array of n costs log n steps a row."""
    def half(found: Column, _: Column) -> Column:
        lo, hi = found["lo"], found["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        at = F.get(cuts, mid)
        up = at <= x if or_equal else at < x
        return F.when(lo < hi, F.struct(F.when(up, mid + 1).otherwise(lo).alias("lo"),
                                        F.when(up, hi).otherwise(mid).alias("hi"))).otherwise(found)

    steps = F.sequence(F.lit(1), F.lit(most.bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(steps, start, half, lambda found: found["lo"])
