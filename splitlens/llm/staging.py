"""Stage tables in the shared checkpoint folder, and session settings of the operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, configure

#: Rows of one Arrow batch handed to Python. Texts have no length bound, so batches are kept
#: short; each operator cuts them further by bytes (``words.chunks``).
ARROW_ROWS = 1024
#: Their bytes, and those of operators that also shuffle, sort and broadcast much: a batch stands
#: in the JVM's and in Python's memory, beside the JVM's heap.
ARROW_BYTES, SHORT_BYTES = 8 << 20, 1 << 19


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator here relies on: AQE, a checkpoint folder, short batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def short_batches(spark: SparkSession) -> None:
    """Batches of ``SHORT_BYTES`` from here on, until ``prepare`` is called again."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SHORT_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts lineage: a lost executor recomputes from the files. The files stay until the
    folder is cleaned, like any other checkpoint.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/splitlens-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` defaults to ``$TOKENIZERS_DIR``."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
