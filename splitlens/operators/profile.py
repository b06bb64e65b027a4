"""Data-quality profiles: duplicates, distinct values, nulls, shapes, traces
(SURVEY A22-A25, D4-D6, P15, P16, O1, O4).

Profiles over several columns are one aggregate per table followed by an ``unpivot`` of
the one-row result, never one job per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_count(df: DataFrame, part: str, subset: list[str] | None = None) -> DataFrame:
    """Rows and surplus copies (rows minus distinct rows, or distinct keys)."""
    cols = subset or df.columns
    per_row = df.groupBy(*cols).agg(F.count("*").alias("_c"))
    return per_row.agg(F.sum("_c").cast("long").alias("n_rows"),
                       F.sum(F.col("_c") - 1).cast("long").alias("n_duplicates")
                       ).select(F.lit(part).alias("part"), "n_rows", "n_duplicates")


def duplicate_counts(parts: dict[str, tuple[DataFrame, list[str] | None]]) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [duplicate_count(df, name, subset) for name, (df, subset) in parts.items()])


def duplicate_rows(df: DataFrame, part: str) -> DataFrame:
    """Every copy of a duplicated row (pandas ``duplicated(keep=False)``) with its
    copy count.  The duplicated keys are found by a partial aggregate and joined back
    null-safely, so a row repeated millions of times is a skewed join key that AQE
    splits, not one window partition."""
    cols = df.columns
    rows = df.alias("r")
    dup = (df.groupBy(*cols).agg(F.count("*").alias("n_copies"))
           .where(F.col("n_copies") > 1).alias("d"))
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in cols])
    return (rows.join(dup, cond, "inner")
            .select(F.lit(part).alias("part"), *[F.col(f"r.{c}") for c in cols],
                    F.col("d.n_copies")))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values (null included) of the given text columns with row counts."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and nulls per column of each table."""
    out = []
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("_rows"),
                     *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        out.append(one.unpivot(["_rows"], df.columns, "column_name", "n_null").select(
            F.lit(name).alias("table_name"), "column_name",
            F.col("_rows").alias("n_rows"), F.col("n_null").cast("long").alias("n_null")))
    return reduce(DataFrame.unionByName, out)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Shape of each table (rows, columns, rows without any null)."""
    out = []
    for name, df in tables.items():
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
        out.append(df.agg(F.count("*").alias("n_rows"),
                          F.count_if(complete).alias("n_complete_rows")).select(
            F.lit(name).alias("table_name"), "n_rows",
            F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_complete_rows"))
    return reduce(DataFrame.unionByName, out)


def null_age_by_arm(master: DataFrame) -> DataFrame:
    """Rows without an age, counted per (assigned) arm."""
    return (master.where(F.col("clnt_age").isNull() & F.col("variation").isNotNull())
            .groupBy("variation").agg(F.count("*").alias("n")))


def visitors_per_visit(events: DataFrame) -> DataFrame:
    """How many visits have 1, 2, ... distinct visitors (two-level aggregate)."""
    per_visit = (events.where(F.col("visit_id").isNotNull()).groupBy("visit_id")
                 .agg(F.count_distinct("visitor_id").alias("n_visitors")))
    return per_visit.groupBy("n_visitors").agg(F.count("*").alias("n_visits"))


def client_trace(events: DataFrame, columns: list[str]) -> DataFrame:
    """The full, ordered event history of the busiest client (most rows, then
    smallest id).  The client is chosen by an aggregate and applied with a semi join, so
    the lookup stays distributed."""
    busiest = (events.groupBy("client_id").agg(F.count("*").alias("_n"))
               .agg(F.max_by("client_id", F.struct(F.col("_n"), -F.col("client_id")))
                    .alias("client_id")))
    return (events.join(busiest, "client_id", "left_semi").select(*columns)
            .orderBy(F.col("date_time").asc_nulls_last(), "event_seq"))


def trace(events: DataFrame, columns: list[str], client: int | None = None,
          visit: str | None = None) -> DataFrame:
    """The ordered events of one client, or of one visit.  Over a clustered table
    (``sources.stage.clustered_table``) the literal reaches the scan, which then reads only
    the row groups that may hold it."""
    if (client is None) == (visit is None):
        raise ValueError("give a client or a visit")
    own = (F.col("client_id") == F.lit(client) if visit is None
           else F.col("visit_id") == F.lit(visit))
    return (events.where(own).select(*columns)
            .orderBy(F.col("date_time").asc_nulls_last(), "event_seq"))
