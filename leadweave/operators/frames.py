"""Helpers over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often they are used: a generator's output is never inlined where it is
    referred to, as an alias of a projection is."""
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__pinned")
    return df.select("*", made).select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[F.col(f"__pinned.{k}").alias(k) for k in columns])
