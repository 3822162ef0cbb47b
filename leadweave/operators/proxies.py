"""Proxies as rows (url, health, state): the healthiest first, and recovery where none is healthy enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINIMUM = 30.0


def usable(proxies: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    """Proxies with health of ``minimum`` or more; if there is none, all of them, set to 100 and RECOVERING."""
    best = proxies.agg(F.max("health").alias("best"))  # one row
    low = F.col("best") < minimum
    rows = proxies.crossJoin(F.broadcast(best)).filter(low | (F.col("health") >= minimum))
    return rows.select(*[{"health": F.when(low, 100.0).otherwise(F.col("health")), "state": F.when(low, "RECOVERING").otherwise(F.col("state"))}.get(c, F.col(c)).alias(c) for c in proxies.columns])


def healthiest(proxies: DataFrame, minimum: float = MINIMUM) -> DataFrame:
    return usable(proxies, minimum).orderBy(F.col("health").desc(), "url").limit(1)
