"""Outer joins whose skewed side can be split.

Spark's full outer join preserves both sides, so neither may be split when one key holds a
large share of the rows.  Here the join is an inner join, which adaptive execution splits on
either side, and the rows of each side without a partner, found by anti joins against the
other side's distinct keys.  Keys that are known to be hot are salted besides: the side
with more rows deals them out over as many salts as it has parts, the other side's rows of
the key are repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stage_table
from .sequence import segment_rows, shuffle_tasks, split_null_keys

SALT = "_salt"


def hot_keys(left: DataFrame, right: DataFrame, on: list[str],
             rows: int | None = None) -> DataFrame | None:
    """The keys with more than ``rows`` rows on a side (by default an even share of all rows over
    several parts for each shuffle partition): ``on``, ``_salts`` (parts of ``rows`` rows on
    the larger side) and ``_left`` (that is the left one).  None without any; otherwise the
    table has at most a row for each ``rows`` rows of both sides."""
    both = [split_null_keys(df, on)[0].select(*on, F.lit(is_left).alias("_l"))
            for df, is_left in ((left, True), (right, False))]
    sizes = both[0].unionByName(both[1]).groupBy(*on).agg(
        F.count_if("_l").alias("_nl"), F.count_if(~F.col("_l")).alias("_nr"))
    most = F.greatest("_nl", "_nr")
    seen = sizes.agg(F.max(most).alias("largest"), F.sum(F.col("_nl") + F.col("_nr")).alias("total")).first()
    rows = rows or segment_rows(seen.total or 0, shuffle_tasks(left))
    if (seen.largest or 0) <= rows:
        return None
    return stage_table(sizes.where(most > rows).select(
        *on, F.ceil(most / rows).cast("int").alias("_salts"),
        (F.col("_nl") >= F.col("_nr")).alias("_left")), "hot-join-keys")


def _salted(df: DataFrame, on: list[str], hot: DataFrame, deals: bool) -> DataFrame:
    """``df`` with a salt: dealt in turn where this side has the more rows (``deals`` is the
    value of ``_left`` that says so), repeated for all salts on the other side, else 0."""
    # the number of a row within its task, so equal rows are dealt out too
    number = F.monotonically_increasing_id()
    d = df.withColumn("_number", number).join(F.broadcast(hot), on, "left")
    own = F.array(F.pmod("_number", "_salts").cast("int"))
    each = F.sequence(F.lit(0), F.col("_salts") - 1)
    salts = (F.when(F.col("_salts").isNull(), F.array(F.lit(0)))
             .when(F.col("_left") == deals, own).otherwise(each))
    return d.withColumn(SALT, F.explode(salts)).drop("_number", "_salts", "_left")


def inner(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return left.join(right, on, "inner")
    return (_salted(left, on, hot, True)
            .join(_salted(right, on, hot, False), [*on, SALT], "inner").drop(SALT))


def full_outer(left: DataFrame, right: DataFrame, on: str | list[str],
               rows: int | None = None) -> DataFrame:
    """``left`` full outer join ``right`` with one key column (USING); a null key has no partner.

    Both sides are read for the sizes of their keys, the inner join and the anti joins, so they
    should be stored or cheap.  ``rows`` is the size above which a key is salted.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot = hot_keys(left, right, on, rows)
    columns = [*left.columns, *(c for c in right.columns if c not in on)]
    out = inner(left, right, on, hot).select(*columns)
    for side, other in ((left, right), (right, left)):
        alone = side.join(other.select(*on).distinct(), on, "left_anti")
        absent = {n: F.lit(None).cast(kind) for n, kind in other.dtypes if n not in on}
        out = out.unionByName(alone.withColumns(absent).select(*columns))
    return out
