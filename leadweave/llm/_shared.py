"""Session helpers of the corpus operators: Arrow batch limits, tables, columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.plans.shared import shared_path, write_shared

__all__ = ["arrow_limits", "crc_mod", "lower_ascii", "parts", "shared_path", "table", "worker_cache", "write_shared"]

#: Bytes of one Arrow batch handed to Python, so that long texts do not pile up in a worker.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


_CACHE: dict[tuple, Any] = {}


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks: one thing at a time, so that operators which follow each other do not add up."""
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]


def arrow_limits(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows unless the session asks for smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions of a keyed exchange: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else; pure ASCII takes the fast path."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the text form of an id, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m
