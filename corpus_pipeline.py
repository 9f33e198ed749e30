"""A training corpus from documents: quality rules, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import packing, quality, simhash, substring, toxicity
from marketlens.llm.common import collected, delete, scratch, table

#: The folders that the stage before has left, of each thread that runs stages.
_left = threading.local()


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage begins when the one before is written, so that one's scratch tables go first."""

    @functools.wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, getattr(_left, "folders", []))
        with collected() as _left.folders:
            return function(spark, docs, sf_dir)

    return stage


@_stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


@_stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the lexicon is learnt from the labelled ones that are left."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@_stage
def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the smallest doc_id, nulls last, and of that the smallest text digest."""
    return simhash.keep_one(docs)


@_stage
def stripped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has, or the same document further ahead, go."""
    return substring.strip(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training: one row for each piece of a document."""
    return packing.pack(docs)


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", single), ("substrings", stripped), ("packing", packed)]
#: Weak supervision, fitted weights, components and a tokenizer are beyond SQL; run() is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
