"""The crawl loop as Structured Streaming: each micro-batch applies outcomes, recovers stale rows, claims, and grows the queue.

State lives in the store's snapshots; the checkpoint makes a restart go on where it stopped. The fetcher is given: a
function from claimed rows to pages (id, url, depth, status, content_type, html), so tests and connectors share one loop.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from threading import Event, Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadweave.functions import html as H
from leadweave.operators import discovery, queue, store

#: Of each crawler's query: a lock held while a round is in progress, and whether no more rounds are to start.
_ROUNDS: dict[str, tuple[Lock, Event]] = {}

Fetch = Callable[[DataFrame], DataFrame]


def crawl_step(tables: store.Store, fetch: Fetch, now, limit: int | None = None) -> dict[str, int]:
    """One round over the stored queue; returns how many rows were claimed, failed, queued and saved.

    Claims are stored before the fetch, and records before the outcomes. After a crash in between, the rows of the round are still
    ``processing``; stale recovery returns them to the queue, and saving their records again changes nothing."""
    q, politeness, records = (tables.read(t) for t in ("crawl_queue", "domain_politeness", "raw_records"))
    q = queue.recover(q, now)
    claimed = queue.claim(q, politeness, now, limit=limit).cache()
    n = claimed.count()
    if not n:
        claimed.unpersist()
        return {"claimed": 0, "failed": 0, "queued": 0, "saved": 0}
    q, politeness = queue.after_claim(q, politeness, claimed, now)
    tables.write("crawl_queue", q)
    tables.write("domain_politeness", politeness)
    q = tables.read("crawl_queue")
    pages = fetch(claimed).withColumn("block", H.block_class(F.col("status"), F.col("content_type"), F.col("html"))).cache()
    good = pages.filter(F.col("block").isNull() & (F.col("status") == 200) & F.col("html").isNotNull())
    outcomes = claimed.select("id").join(good.select("id", F.lit(True).alias("ok")), "id", "left").select("id", now.alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    q = queue.apply_outcomes(q, outcomes)
    fresh = queue.expand(good, q, now)
    found = discovery.records_of_pages(good, now)
    added = found.select("fingerprint").distinct().join(records.select("fingerprint"), "fingerprint", "left_anti")
    result = {"claimed": n, "failed": n - good.select("id").distinct().count(), "queued": fresh.count(), "saved": added.count()}
    tables.write("raw_records", store.save_records(records, found))
    tables.write("crawl_queue", q.unionByName(fresh))
    pages.unpersist()
    claimed.unpersist()
    return result


def run_crawler(tables: store.Store, fetch: Fetch, checkpoint: str, interval: str = "5 seconds", limit: int | None = None, on_round: Callable[[dict[str, int]], None] | None = None, pause: float = 5.0) -> StreamingQuery:
    """Rounds at an interval until the query is stopped; ``stop(query)`` ends it after the round in progress.

    A round that fails is logged and told as one error; after a ``pause`` the next one recovers what it left."""

    busy, ending = Lock(), Event()

    def step(_: DataFrame, __: int) -> None:
        with busy:
            if ending.is_set():
                return
            try:
                done = crawl_step(tables, fetch, F.current_timestamp(), limit)
            except Exception:
                logging.getLogger(__name__).exception("a crawl round failed")
                done = {"errors": 1}
            if on_round:
                on_round(done)
        if "errors" in done:
            ending.wait(pause)

    ticks = tables.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    _ROUNDS[str(query.id)] = busy, ending
    return query


def stop(query: StreamingQuery, seconds: int = 10) -> bool:
    """End the query once the round in progress has been stored, after ``seconds`` at the latest."""
    busy, ending = _ROUNDS.pop(str(query.id), (Lock(), Event()))
    ending.set()
    if busy.acquire(timeout=seconds):
        busy.release()
    query.stop()
    return bool(query.awaitTermination(seconds)) if query.isActive else True


def stream_outcomes(spark: SparkSession, events: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Outcome events (id, at, ok) of a stream, applied to the stored queue batch by batch."""
    tables = store.Store(spark, store_path)

    def step(batch: DataFrame, _: int) -> None:
        tables.write("crawl_queue", queue.apply_outcomes(tables.read("crawl_queue"), batch))

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
