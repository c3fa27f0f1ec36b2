"""A corpus pipeline over documents, one operator of the llm subpackage per stage.

Toxic documents go, then exact copies, then near copies; sources are mixed to their target weights, which
repeats some documents and leaves others out; and what is left is packed into sequences.  Each stage
reads all rows that its predecessor kept.  All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession

from routelens.llm import (
    op1_gated_toxicity,
    op4_minmax_dedup,
    op5_minimum_slack_packing,
    op8_systematic_mixing,
    op9_block_naming,
)
from routelens.plans.shared import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network scores as toxic; it learns from the labels that op1 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op1_gated_toxicity.without_toxic(docs, labels, ~op1_gated_toxicity.held_out(3, 1))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of equal normalised texts."""
    return op9_block_naming.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each component of five-word shingle similarity of 0.8 or more."""
    return op4_minmax_dedup.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    return op8_systematic_mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    return op5_minimum_slack_packing.packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot train the network or run the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
