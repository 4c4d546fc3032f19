"""A corpus pipeline: quality rules, near copies, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``, whatever else these hold.

Documents with a null or empty text have no words and go in the first stage; texts of any length pass through whole.
Rows without doc_id are no one's copy and stay; of rows that repeat a doc_id one stays, as of any copies. Columns whose
names an operator uses for its own results pass through untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe, decontaminate, neardup, pii, quality
from pulsegrid.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and all rules of the threshold table."""
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least doc_id."""
    return neardup.keep(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every personal span replaced by its kind; n_chars counts the new text."""
    return pii.redact(docs, pii.train(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of each document, encoded and decoded: doc_id, n_tokens and digests of ids and bytes."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("byte-level BPE", tokens),
]

#: The model of the fourth stage and the merges of the fifth are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored in the shared folder in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k + 1}")
    return docs
