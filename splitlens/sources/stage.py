"""Stage tables: Parquet in the shared folder, optionally clustered for point lookups.

A stage table cuts the lineage (a lost executor recomputes from the files, not from the raw
inputs) and, unlike an RDD checkpoint, is a columnar scan: readers fetch the columns they
name and push their filters into it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for a stage table."""
    return f"{checkpoint_dir(spark)}/splitlens-stage/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back; the folder's life is the checkpoint folder's."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered_table(df: DataFrame, name: str, by: list[str], bloom: list[str] = (),
                    group_bytes: int = 16 << 20) -> DataFrame:
    """A stage table whose files hold ranges of ``by``, sorted, in row groups of about
    ``group_bytes``.

    A lookup on the leading column of ``by`` reads the row groups whose min/max hold the
    value; one on a ``bloom`` column those whose dictionary or Bloom filter may hold it.  The
    range partitioning also splits a hot leading value by the columns behind it.
    """
    path = stage_path(df.sparkSession, name)
    writer = df.repartitionByRange(*by).sortWithinPartitions(*by).write
    writer = writer.option("parquet.block.size", group_bytes)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
