"""The corpus pipeline: language ID, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from leadweave.llm._shared import table, write_shared
from leadweave.llm.exact_dedup import drop_exact_copies
from leadweave.llm.language_id import drop_rejected
from leadweave.llm.packing import pack_documents
from leadweave.llm.simhash import drop_near_copies
from leadweave.plans.shared import drop_paths, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LAST: dict[str, list[str]] = {}


def _stage(f: Stage) -> Stage:
    """A stage whose intermediate tables go when the next one starts: by then its result has been written and read again."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_paths(spark, _LAST.pop(app, []))
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _LAST[app] = paths
        return out

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The models are fitted on the labelled documents among them."""
    return drop_rejected(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return drop_exact_copies(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return drop_near_copies(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in token sequences."""
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Models, fingerprints and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
