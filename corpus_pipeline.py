"""Corpus pipeline: from `documents` to token files, five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns
a DataFrame; all but the last return the columns of `documents`. run() writes each stage's
rows as Parquet to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from guestsignal.llm import (
    op2_token_output,
    op3_toxicity,
    op4_decontamination,
    op5_mixing,
    op8_ngram_jaccard_join,
)
from guestsignal.llm.shared import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    classifier = op3_toxicity.learnt(docs, table(spark, sf_dir, "labels"))
    return op3_toxicity.keep_clean(docs, classifier)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id."""
    return op8_ngram_jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return op4_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return op5_mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order; a row for each document as read back from them."""
    return op2_token_output.read(op2_token_output.write(docs))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The stages are a classifier, iterated graph work and a coder: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
