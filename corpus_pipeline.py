"""Documents to packed training sequences: toxicity, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept and returns the columns of documents; the last returns the packing plan.
Each sets its session to hand Python few rows at once, so that four stages in a
row fit the executors' memory; plans run after a stage returns, so that stays set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import lines, neardup, packing, toxicity
from quillmark.llm.batches import few_at_once
from quillmark.llm.store import materialize, table

#: Models and tokenizers can't be written in SQL; the tests hold each stage against fixtures and plain versions.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, scores below one half."""
    few_at_once(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks that occur earlier in the corpus."""
    few_at_once(spark)
    return lines.dedup(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    few_at_once(spark)
    return neardup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences."""
    few_at_once(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", neardup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
