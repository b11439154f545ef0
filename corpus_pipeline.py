"""A corpus from documents: quality rules, near-duplicates, benchmark passages, secrets, packing.

Every stage takes an empty table to an empty one, leaves columns that it does not name as they are, whatever their
names, and takes texts whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import cascade, decontam, near, packing, secret_scan, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null texts have no words, so they go; repeated rows are judged each."""
    return cascade.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more stays: that of the smallest doc_id.

    Null doc_ids come last, then the smaller hash of the text; of rows that repeat doc_id and text one stays at most;
    null and blank texts are equal.
    """
    return near.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text go; null texts hold none; repeated rows go or stay together."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets masked and n_chars set anew; null texts stay null; repeated rows are masked each."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; null texts are an end id alone; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_secrets", mask_secrets), ("best_fit_packing", pack)]

#: Near-duplicate components and best-fit places are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, shared.save(stage(spark, docs, sf_dir), name)
        shared.drop(before)  # the input itself is no saved table
    return STAGES[-1][1](spark, docs, sf_dir)
