"""The crawl queue as batch functions over its snapshots: claim, outcome, recovery, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions import html as H
from leadweave.functions import urls
from leadweave.functions.dates import seconds_before
from leadweave.operators.frames import pinned
from leadweave.operators.store import enqueue, upsert

MAX_FAILURES = 5
DELAY_SECONDS = 5
STALE_SECONDS = 600
MAX_DEPTH = 3
MAX_LINKS = 20
SAME_HOST, OTHER_HOST, SEED = 5, 1, 10


def pending(queue: DataFrame, limit: int = 100) -> DataFrame:
    return queue.filter("status = 'pending'").orderBy(F.col("priority").desc(), "created_at", "id").limit(limit)


def eligible(queue: DataFrame, politeness: DataFrame, now: Column, delay: int = DELAY_SECONDS, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Pending rows with tries left whose host was not visited within the delay."""
    seen = politeness.select("domain", "last_visited_at")
    return queue.filter((F.col("status") == "pending") & (F.col("fail_count") < max_failures)).join(seen, "domain", "left").filter(F.col("last_visited_at").isNull() | (F.col("last_visited_at") <= seconds_before(now, F.lit(delay)))).drop("last_visited_at")


def claim(queue: DataFrame, politeness: DataFrame, now: Column, delay: int = DELAY_SECONDS, limit: int | None = None) -> DataFrame:
    """The rows to fetch next: the best of each host, so that no host is visited twice within the delay; at most ``limit``.

    With a limit of 1 this is the single next row. An aggregate picks the best, so one host with most of the queue is folded
    before the exchange."""
    best = F.min_by(F.struct("id", "url", "depth", "priority", "created_at"), F.struct(-F.col("priority"), "created_at", "id"))
    rows = eligible(queue, politeness, now, delay).groupBy("domain").agg(best.alias("row")).select("row.*", "domain")
    return rows if limit is None else rows.orderBy(F.col("priority").desc(), "created_at", "id").limit(limit)


def after_claim(queue: DataFrame, politeness: DataFrame, claimed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Queue and politeness once rows are claimed."""
    taken = claimed.select("id", F.lit("processing").alias("status"), now.alias("last_attempted"))
    visited = claimed.select("domain", now.alias("last_visited_at")).distinct()
    return upsert(queue, taken, ["id"], replace=("status", "last_attempted")), upsert(politeness, visited, ["domain"], replace=("last_visited_at",))


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Outcomes (id, at, ok) in order of time: a success completes and clears the failures; a failure counts, and is final
    from the last one allowed on. Only what follows the last success and how many failures that is decide, so each row's
    outcomes fold to two numbers before the join."""
    last_ok = F.max(F.when(F.col("ok"), F.col("at")))
    folded = outcomes.groupBy("id").agg(last_ok.alias("ok_at"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("at")))).alias("failed_at"))
    folded = folded.select("id", F.col("ok_at").isNotNull().alias("had_ok"), F.size(F.filter("failed_at", lambda t: F.col("ok_at").isNull() | (t > F.col("ok_at")))).alias("since"))
    joined = queue.join(folded, "id", "left")
    start = F.when(F.col("had_ok"), 0).otherwise(F.col("fail_count"))
    fails = start + F.col("since")
    status = F.when(F.col("since").isNull(), F.col("status")).when(F.col("since") == 0, "completed").when(fails - 1 >= max_failures - 1, "failed").otherwise("pending")
    return joined.select(*[status.alias(c) if c == "status" else F.when(F.col("since").isNull(), F.col(c)).otherwise(fails).cast("int").alias(c) if c == "fail_count" else F.col(c) for c in queue.columns])


def is_stale(now: Column, seconds: int = STALE_SECONDS) -> Column:
    return (F.col("status") == "processing") & (F.col("last_attempted") <= seconds_before(now, F.lit(seconds)))


def recover(queue: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Rows stuck in processing become pending again."""
    return queue.withColumn("status", F.when(is_stale(now, seconds), "pending").otherwise(F.col("status")))


def links_of(pages: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(parent, pos, url, priority, depth) of the admissible links of pages (url, depth, html), in the page's order."""
    found = pages.filter((F.col("depth") < max_depth) & (F.coalesce("html", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).select(F.col("url").alias("parent"), "depth", F.posexplode(H.anchors(F.col("html"))).alias("pos", "a"))
    absolute = pinned(found, url=urls.resolve(F.col("parent"), F.col("a.href")))
    good = absolute.filter(urls.is_crawlable(F.col("a.href"), F.col("url")) & ~urls.is_directory(F.col("url"), F.col("a.text")))
    same = urls.host(F.col("url")) == urls.host(F.col("parent"))
    return good.select("parent", "pos", "url", F.when(same, SAME_HOST).otherwise(OTHER_HOST).alias("priority"), (F.col("depth") + 1).alias("depth"))


def expand(pages: DataFrame, queue: DataFrame, now: Column, max_depth: int = MAX_DEPTH, max_links: int = MAX_LINKS) -> DataFrame:
    """Queue rows for the links of pages: new URLs only, the first ``max_links`` new ones of each page."""
    fresh = links_of(pages, max_depth).join(queue.select("url"), "url", "left_anti")
    fresh = fresh.groupBy("parent", "url").agg(F.min_by(F.struct("pos", "priority", "depth"), "pos").alias("x")).select("parent", "url", "x.*")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("pos"))
    return enqueue(queue, fresh.withColumn("rank", rank).filter(F.col("rank") <= max_links).select("url", "priority", "depth"), now)


def seeds(queue: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """Queue rows for seed URLs."""
    return enqueue(queue, targets.select("url", F.lit(SEED).alias("priority"), F.lit(0).alias("depth")), now)


def search_seed(query: Column) -> Column:
    """URL of a results page for a query."""
    return F.concat(F.lit("https://html.duckduckgo.com/html/?q="), F.replace(query, F.lit(" "), F.lit("+")))


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def visit_gaps(visits: DataFrame, seconds: float = 2.0) -> DataFrame:
    """Visits (domain, at) with the gap to the one before at the same host, and whether that was too short."""
    before = F.lag("at").over(Window.partitionBy("domain").orderBy("at"))
    return visits.withColumn("gap", (F.unix_micros("at") - F.unix_micros(before)) / 1e6).withColumn("too_soon", F.coalesce(F.col("gap") < seconds, F.lit(False)))
