"""Heads, tails and the first rows per key.

None of them sorts the table: a head or tail is a bounded top-n per task and one merge
(``TakeOrderedAndProject``); the first k rows per key are limited to k in every task before
the shuffle (``WindowGroupLimit``), so a hot key sends k rows per task and no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (ascending, nulls last)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows in ``order``, in that order: a head of the reversed order."""
    last = df.orderBy(*[F.col(c).desc_nulls_first() for c in order]).limit(n)
    return last.orderBy(*[F.col(c).asc_nulls_last() for c in order])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key in ``order``, numbered from 1; null keys are a key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
