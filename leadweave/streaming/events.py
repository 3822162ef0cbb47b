"""Event-time operators over an event stream (ts, user_id, event_type, value, event_id)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_time(events: DataFrame) -> DataFrame:
    """``ts`` as a timestamp with a zone, as watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Counts and sums by window and type; late rows beyond the watermark are left out of a stream."""
    e = with_time(events)
    if late:
        e = e.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = with_time(events)
    if late:
        e = e.withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.unix_seconds("s.start").alias("session_start"), F.unix_seconds("s.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return with_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def failure_state(events: DataFrame, max_failures: int = 5) -> DataFrame:
    """(user_id, fails, status) after each batch: the queue's failure rule as keyed state, an error being a failure."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        last = None
        for kind in rows["event_type"]:
            fails = fails + 1 if kind == "error" else 0
            last = kind
        state.update((fails,))
        status = "completed" if last != "error" else "failed" if fails >= max_failures else "pending"
        yield pd.DataFrame({"user_id": [key[0]], "fails": [fails], "status": [status]})

    return with_time(events).groupBy("user_id").applyInPandasWithState(step, "user_id long, fails int, status string", "fails int", "update", GroupStateTimeout.NoTimeout)
