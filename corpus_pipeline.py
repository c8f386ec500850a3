"""A corpus from raw documents to packed training sequences: every stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written before the next reads it. All but the last return
documents, with the columns they came with.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chatlake.llm import jaccard, mixing, packing, quality, secrets
from chatlake.session import discard, discard_path, materialise, scratch, written


#: Folders that the stage before wrote for itself.
_LEFT: list[str] = []


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's own files are needed until its output is written. When the next stage is called, its input is that output,
    so what the stage before left goes, unless the input still reads it."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _LEFT else []
        for path in _LEFT:
            if not any(f"/{path.rstrip('/').rsplit('/', 1)[-1]}/" in name for name in read):
                discard_path(spark, path)
        before = set(written())
        out = function(spark, docs, sf_dir)
        _LEFT[:] = [path for path in written() if path not in before]
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host fails, leave."""
    return quality.filtered(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one of the smallest id stays."""
    return jaccard.representatives(docs)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced."""
    return secrets.redacted(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number."""
    return mixing.mixed(docs)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence. Several copies of a document are packed one by one."""
    return packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: The statistical tests, the schedule and the tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage wrote for itself, and its input, go once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        with scratch(spark) as keep:
            after = keep(materialise(step(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
