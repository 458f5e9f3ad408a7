"""Corpus pipeline: quality, near duplicates, decontamination, mixture,
token packs.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``. A
stage's result is written as Parquet and read again as the next one's input.
All stages hand their rows to Python in batches of bounded bytes.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from viewlens.llm import decontaminate, mixing, ngram_join, quality, tokens
from viewlens.llm.common import bounded_batches, documents, land
from viewlens.session import scratch_path


def bounded(stage):
    """``stage`` with batches of bounded bytes."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


@bounded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@bounded
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return ngram_join.keep_one(docs)


@bounded
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks."""
    return mixing.mix(docs)


@bounded
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as compressed token packs, read back: doc_id, start,
    n_tokens, ids_crc32 of each copy."""
    path = scratch_path(spark, "tokens")
    tokens.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read(spark, path)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("mixture", mixture_stage), ("tokens", token_stage)]

#: The classifier and the tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
