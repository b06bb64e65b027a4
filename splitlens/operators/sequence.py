"""Ordered per-key scans (lag / lead / running sum / forward fill) that survive a hot key.

A plain ``Window.partitionBy(key).orderBy(time, seq)`` sends every row of a key to one task,
so a bot-like client holding a third of all events becomes one straggler task.  The scans
here take their segments from the data:

1. :func:`split_null_keys` sets rows with a null key apart.  They have no neighbours, yet a
   window would gather them all in one group.
2. :func:`find_heat` counts rows per key (a partial aggregate) and keeps the *hot keys*,
   those with more rows than a task should get at once.  For each of them a mergeable KLL
   sketch of the order time gives *cut points* of equal row counts; an instant that holds
   several cut points by itself is cut further by its sequence numbers.  Hot keys and cut
   points number at most a few per task, whatever the table's size, so the table of them
   may be broadcast.  Quantile sketches are random: the table is written once, so every
   branch of a plan sees the same cuts.
3. :meth:`Heat.add_segment` numbers the segment of every row of a hot key by a binary search
   in its key's cut points; rows of other keys get a null segment.
4. The scans' windows run per ``(key, segment)``: one shuffle of the row table.  For hot
   keys a partial aggregate over their rows keeps one summary row per segment; a window over
   that small table links each segment to its neighbours and carries the offset, and the
   result is joined back by broadcast.

Without hot keys (the usual case) nothing is added to the rows and the scans are plain
windows.  ``mode="window"`` keeps that plan for any table (the brute force of the tests).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.search import count_below
from ..sources.stage import stage_table

SEGMENT = "_seg"
# A key is hot when it has more rows than a task should sort at once: an even share of the
# table over so many segments for each shuffle partition, but not fewer than MIN_ROWS.
SEGMENTS_PER_TASK = 8
MIN_ROWS = 20_000
MAX_CUTS = 2048  # of one key's times, and of one instant's sequence numbers
SUB = 1 << 20  # room for the segments of one instant
NULLS_LAST = 9_223_372_036_854_775_807
BEFORE = Window.unboundedPreceding, -1
UP_TO = Window.unboundedPreceding, Window.currentRow
WHOLE = Window.unboundedPreceding, Window.unboundedFollowing


def window_order(order: Sequence[str]) -> list[Column]:
    """Ascending, nulls last (pandas' sort order, SURVEY T13)."""
    return [F.col(c).asc_nulls_last() for c in order]


def struct_order(order: Sequence[str]) -> Column:
    """A struct whose natural ordering equals the window order: struct comparison puts
    nulls first, so each column is preceded by its null flag."""
    fields = []
    for i, c in enumerate(order):
        fields.append(F.col(c).isNull().alias(f"_n{i}"))
        fields.append(F.col(c).alias(f"_v{i}"))
    return F.struct(*fields)


# -- null keys, hot keys and their cut points ---------------------------------------------
def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all keys present, and the others."""
    present = _all_present(keys)
    return df.where(present), df.where(~present)


def _micros(time: str) -> Column:
    """A TIMESTAMP_NTZ column as microseconds; null times come last."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(F.timestamp_diff("MICROSECOND", epoch, F.col(time)), F.lit(NULLS_LAST))


def _sequence(seq: str) -> Column:
    return F.coalesce(F.col(seq).cast("long"), F.lit(NULLS_LAST))


def _quantiles(df: DataFrame, by: list[str], value: Column, parts: Column, most: int) -> DataFrame:
    """``by`` and ``_cuts``: cut points of ``value`` into ``_parts`` (of at most ``most``) parts of
    equal counts per group, ascending and with repeats.  The sketch's rank error is below
    half a part."""
    grid = [i / (2 * most) for i in range(1, 2 * most)]
    sketch = F.kll_sketch_agg_bigint(value, F.lit(min(65_535, max(200, 8 * most))))
    found = df.groupBy(*by).agg(sketch.alias("_s"), F.max(parts).alias("_parts"))
    ranked = F.kll_sketch_get_quantile_bigint("_s", F.array(*map(F.lit, grid)))
    found = found.select(*by, ranked.alias("_q"), "_parts")
    # the cut behind part i of p is quantile i / p of the grid
    picked = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.get(
        F.col("_q"), F.floor(i * (2 * most) / F.col("_parts")).cast("int") - 1))
    return found.select(*by, F.array_sort(picked).alias("_cuts"))


@dataclass(frozen=True)
class Heat:
    """The hot keys of a table: ``table`` has the keys, ``_cuts`` (distinct times, ascending)
    and ``_subcuts`` (for each of them, cut points of the sequence numbers at that time)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    table: DataFrame

    def add_segment(self, df: DataFrame) -> DataFrame:
        """``df`` with the segment number, which rises along the order within a hot key and is
        null for other keys."""
        time, seq = _micros(self.order[0]), _sequence(self.order[1])
        d = df.join(F.broadcast(self.table), list(self.keys), "left")
        d = d.withColumn("_at", F.when(F.col("_cuts").isNotNull(), count_below(F.col("_cuts"), time, MAX_CUTS)))
        on_cut = F.get("_cuts", F.col("_at")) == time
        sub = F.when(on_cut, 1 + count_below(F.get("_subcuts", F.col("_at")), seq, MAX_CUTS)).otherwise(0)
        segment = F.col("_at").cast("long") * SUB + F.coalesce(sub, F.lit(0))
        return d.withColumn(SEGMENT, segment).drop("_cuts", "_subcuts", "_at")


def segment_rows(total: int, tasks: int) -> int:
    """Rows above which a key is hot in a table of ``total`` rows."""
    return max(MIN_ROWS, math.ceil(total / (SEGMENTS_PER_TASK * tasks)))


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _all_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return present


def find_heat(df: DataFrame, keys: Sequence[str], order: Sequence[str], mode: str = "segmented",
              rows: int | None = None) -> tuple[Heat | None, bool]:
    """The hot keys of ``df``, None when there are none, and whether there are null keys.

    ``df`` should be a stored table: it is read once for the counts and, if any key is hot,
    again for the cut points of the hot keys' rows.  ``order`` names a time and a sequence
    column; segments have about ``rows`` rows at most.
    """
    if mode == "window":
        return None, True
    keys, order = tuple(keys), tuple(order)
    present = _all_present(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    seen = sizes.agg(F.max(F.when(present, F.col("_n"))).alias("largest"),
                     F.sum("_n").alias("total"), F.max(~present).alias("nulls")).first()
    rows = rows or segment_rows(seen.total or 0, shuffle_tasks(df))
    if (seen.largest or 0) <= rows:
        return None, bool(seen.nulls)
    largest = seen.largest
    sizes = stage_table(sizes.where(present & (F.col("_n") > rows)), "hot-keys")
    present, _ = split_null_keys(df, keys)
    most = min(MAX_CUTS, math.ceil(2 * largest / rows))
    parts = F.least(F.lit(most), F.ceil(2 * F.col("_n") / rows)).cast("int")
    hot = present.join(F.broadcast(sizes), list(keys)).select(
        *keys, "_n", _micros(order[0]).alias("_t"), _sequence(order[1]).alias("_v"))
    cuts = stage_table(_quantiles(hot, list(keys), F.col("_t"), parts, most), "cuts")

    # a time that is a cut point several times over has several parts' rows by itself
    tied = (cuts.select(*keys, F.explode("_cuts").alias("_t")).groupBy(*keys, "_t")
            .agg(F.count("*").alias("_ties")).where(F.col("_ties") > 1))
    tied = stage_table(tied, "tied-times")
    subs = _quantiles(hot.join(F.broadcast(tied), [*keys, "_t"]), [*keys, "_t"], F.col("_v"),
                      F.col("_ties") + 1, most + 1)
    subs = subs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "_t", F.array_distinct("_cuts")))).alias("_subs"))
    none = F.array().cast("array<bigint>")
    distinct = F.array_distinct("_cuts")
    table = cuts.join(F.broadcast(subs), list(keys), "left").select(
        *keys, distinct.alias("_cuts"),
        F.transform(distinct, lambda t: F.coalesce(F.col("_subs")[t], none)).alias("_subcuts"))
    return Heat(keys, order, stage_table(table, "heat")), bool(seen.nulls)


# -- scans --------------------------------------------------------------------------------
def segments_of(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SEGMENT)


def hot_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(SEGMENT).isNotNull())


def linked(df: DataFrame, keys: Sequence[str], summary: DataFrame) -> DataFrame:
    """``df`` with its segment's summary; a row per segment, so it may be broadcast."""
    return df.join(F.broadcast(summary), [*keys, SEGMENT], "left")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
               prev_name: str, next_name: str) -> DataFrame:
    """Add the previous and next ``value`` of each row within its key, in ``order``.  Rows
    with segments (:meth:`Heat.add_segment`) are scanned segment by segment."""
    if SEGMENT not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*window_order(order))
        return (df.withColumn(prev_name, F.lag(value).over(w))
                .withColumn(next_name, F.lead(value).over(w)))

    w = Window.partitionBy(*keys, SEGMENT).orderBy(*window_order(order))
    d = (df.withColumn("_prev_in", F.lag(value).over(w))
         .withColumn("_next_in", F.lead(value).over(w))
         .withColumn("_first", F.lag(F.lit(1)).over(w).isNull())
         .withColumn("_last", F.lead(F.lit(1)).over(w).isNull()))
    at = struct_order(order)
    summary = hot_rows(df).groupBy(*keys, SEGMENT).agg(
        F.min_by(value, at).alias("_seg_first"), F.max_by(value, at).alias("_seg_last"))
    over = segments_of(keys)
    summary = summary.select(*keys, SEGMENT, F.lag("_seg_last").over(over).alias("_prev_seg"),
                             F.lead("_seg_first").over(over).alias("_next_seg"))
    out = linked(d, keys, summary)
    return (out.withColumn(prev_name, F.when(F.col("_first"), F.col("_prev_seg"))
                           .otherwise(F.col("_prev_in")))
            .withColumn(next_name, F.when(F.col("_last"), F.col("_next_seg"))
                        .otherwise(F.col("_next_in")))
            .drop("_prev_in", "_next_in", "_first", "_last", "_prev_seg", "_next_seg"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                name: str) -> DataFrame:
    """Add the running sum of ``value`` (rows up to and including this one) per key."""
    if SEGMENT not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*window_order(order)).rowsBetween(*UP_TO)
        return df.withColumn(name, F.sum(value).over(w))

    w = Window.partitionBy(*keys, SEGMENT).orderBy(*window_order(order)).rowsBetween(*UP_TO)
    d = df.withColumn("_run_in", F.sum(value).over(w))
    totals = hot_rows(df).groupBy(*keys, SEGMENT).agg(F.sum(value).alias("_seg_total"))
    totals = totals.select(*keys, SEGMENT, F.sum("_seg_total").over(
        segments_of(keys).rowsBetween(*BEFORE)).alias("_offset"))
    out = linked(d, keys, totals)
    return (out.withColumn(name, F.col("_run_in") + F.coalesce(F.col("_offset"), F.lit(0)))
            .drop("_run_in", "_offset"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                  name: str) -> DataFrame:
    """Add the last non-null ``value`` among the rows strictly before each row of its key
    (a forward fill shifted by one row)."""
    if SEGMENT not in df.columns:
        w = Window.partitionBy(*keys).orderBy(*window_order(order)).rowsBetween(*BEFORE)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))

    d = df.withColumn("_cv", value)
    w = Window.partitionBy(*keys, SEGMENT).orderBy(*window_order(order)).rowsBetween(*BEFORE)
    at = F.when(F.col("_cv").isNotNull(), struct_order(order))
    summary = hot_rows(d).groupBy(*keys, SEGMENT).agg(F.max_by("_cv", at).alias("_seg_last"))
    summary = summary.select(*keys, SEGMENT, F.last("_seg_last", ignorenulls=True).over(
        segments_of(keys).rowsBetween(*BEFORE)).alias("_carry"))
    d = d.withColumn("_cf_in", F.last("_cv", ignorenulls=True).over(w))
    return (linked(d, keys, summary)
            .withColumn(name, F.coalesce(F.col("_cf_in"), F.col("_carry")))
            .drop("_cv", "_cf_in", "_carry"))


def group_values(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 over_window: dict[str, Callable[[WindowSpec], Column]],
                 grouped: dict[str, Column]) -> DataFrame:
    """Attach aggregates of each row's key to the row: ``over_window`` gives their window
    forms, ``grouped`` the same values as grouped aggregates.

    Keys that are not hot are aggregated over the scan's own partitioning and order, so no
    shuffle or sort is added.  Hot keys are reduced by partial aggregates; their values, a
    row per hot key, are joined by broadcast.
    """
    by = [*keys, SEGMENT] if SEGMENT in df.columns else list(keys)
    w = Window.partitionBy(*by).orderBy(*window_order(order)).rowsBetween(*WHOLE)
    d = df.withColumns({name: form(w) for name, form in over_window.items()})
    if SEGMENT not in df.columns:
        return d
    hot = hot_rows(df).groupBy(*keys).agg(*[c.alias(f"_hot_{n}") for n, c in grouped.items()])
    d = d.join(F.broadcast(hot), list(keys), "left")
    return d.withColumns({n: F.when(F.col(SEGMENT).isNull(), F.col(n)).otherwise(
        F.col(f"_hot_{n}")) for n in grouped}).drop(*[f"_hot_{n}" for n in grouped])
