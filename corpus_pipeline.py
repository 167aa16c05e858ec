"""A corpus pipeline: documents that pass the quality classifier, without copies and near copies, mixed by source, encoded."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipweave.llm.bpe import encode
from clipweave.llm.exact_dedup import drop_copies
from clipweave.llm.mixing import mixed_rows
from clipweave.llm.near_dedup import drop_near_duplicates
from clipweave.llm.quality import drop_rejected
from clipweave.llm.shared import noted, release, scratch

#: The stages draw random choices, so SQL can't express the result.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before = threading.local()


def _stage(f: Stage) -> Stage:
    """A stage that deletes the scratch tables of the stage before it, whose result is a table of its own when the next stage reads it."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, getattr(_before, "paths", []))
        _before.paths = []
        with noted() as paths:
            _before.paths = paths
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, doesn't reject."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


@_stage
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to: doc_id, ids, decoded."""
    return encode(docs, decoded=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            release(spark, last)
            last = [path]
    return docs
