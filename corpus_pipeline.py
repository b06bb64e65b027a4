"""The corpus pipeline: documents through the stages of ``STAGES``, each over Parquet.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it to the
shared checkpoint folder and reads it again as the next stage's input, so a lost executor
recomputes one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlens.llm import mixing, ngram_join, quality_rules, sp_sampling, suffix_dedup
from splitlens.llm.staging import prepare, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that an earlier document, or place, has."""
    prepare(spark)
    return suffix_dedup.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document's sampled segmentations, a row for each sample."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(sp_sampling.ROWS))
    found = sp_sampling.encode(docs.select("doc_id", "text", "lang", "source"))
    rows = found.select("doc_id", "lang", "source", F.posexplode("samples").alias("sample", "s"))
    return rows.select("doc_id", "lang", "source", "sample", "s.*")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL cannot express the token measures of the first stage; tests hold ``run`` against brute
#: force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the last one's rows are the result."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{i}")
    return docs
