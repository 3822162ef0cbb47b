"""Connectors: batch readers for search-result pages and map responses, a registry of sources, and a hook for models.

Fetching is injected as ``module:function``: a function from (url, params) to a response text or None. A reader has one
partition a page or request, so the cluster's task slots bound how many requests are in flight, and a task that fails
is fetched again by Spark.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from importlib import import_module

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leadweave.functions import urls

# End points of the search engine and the map services, rows of a page of results.
SEARCH_URL = "https://html.duckduckgo.com/html/"
MAP_URLS = ("https://overpass-api.de/api/interpreter", "https://overpass.kumi.systems/api/interpreter")
PAGE_ROWS = 30
# Fixed value: the class of a result's link.
RESULT = "result__a"


def resolve_function(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


class _Pages(InputPartition):
    def __init__(self, query: str, pages: range):
        self.query, self.pages = query, pages


class SearchPages(DataSource):
    """``format("search_pages")``: option ``queries`` (newline-separated), ``pages`` and ``fetcher``; rows (query, page, html).

    With option ``rows``, a query is one partition: its pages are asked for in order, up to the first that fails or shows no result,
    or until that many results are seen. Without, every page is a partition of its own and all are asked for."""

    @classmethod
    def name(cls) -> str:
        return "search_pages"

    def schema(self) -> str:
        return "query string, page int, html string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.pages, self.rows, self.fetcher = int(options.get("pages", 1)), int(options.get("rows", 0)), options["fetcher"]

    def partitions(self) -> Sequence[InputPartition]:
        if self.rows:
            return [_Pages(q, range(self.pages)) for q in self.queries]
        return [_Pages(q, range(p, p + 1)) for q in self.queries for p in range(self.pages)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        fetch, seen = resolve_function(self.fetcher), 0
        for page in partition.pages:
            html = fetch(SEARCH_URL, {"q": partition.query, "s": page * PAGE_ROWS})
            seen += html.count(RESULT) if html else 0
            if html is None or (self.rows and RESULT not in html):
                return
            yield partition.query, page, html
            if self.rows and seen >= self.rows:
                return


class MapResponses(DataSource):
    """``format("map_responses")``: option ``query`` (the map service's text) and ``fetcher``; one row (json) from the first
    service that answers with a JSON object."""

    @classmethod
    def name(cls) -> str:
        return "map_responses"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> DataSourceReader:
        return _MapReader(self.options)


class _MapReader(DataSourceReader):
    def __init__(self, options):
        self.query, self.fetcher = options["query"], options["fetcher"]

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = resolve_function(self.fetcher)
        for url in MAP_URLS:
            answer = fetch(url, {"data": self.query})
            if answer and answer.lstrip().startswith("{"):
                yield (answer,)
                return


def register(spark: SparkSession) -> None:
    for source in (SearchPages, MapResponses):
        spark.dataSource.register(source)


class Sources:
    """Named functions (spark, query, wilaya, limit) -> records with ``ord``; more may be added at run time."""

    def __init__(self):
        self.known: dict[str, Callable[[SparkSession, str, str | None, int], DataFrame]] = {}

    def add(self, name: str, source: Callable[[SparkSession, str, str | None, int], DataFrame]) -> None:
        self.known[name] = source

    def records(self, spark: SparkSession, query: str, wilaya: str | None, limit: int) -> list[DataFrame]:
        return [f(spark, query, wilaya, limit) for f in self.known.values()]


class HostGap:
    """Waits until a host's last visit is ``seconds`` ago, moved by up to ``jitter`` of them to either side."""

    def __init__(self, seconds: float, jitter: float = 0.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.jitter, self.clock, self.sleep, self.last = seconds, jitter, clock, sleep, {}

    def wait(self, host: str) -> None:
        gap = self.seconds * (1 + self.jitter * random.uniform(-1, 1))
        left = self.last.get(host, -gap) + gap - self.clock() if host in self.last else 0
        if left > 0:
            self.sleep(left)
        self.last[host] = self.clock()


def fetch_pages(targets: DataFrame, fetcher: str, delay: float = 0.0, jitter: float = 0.0, at_once: int | None = None, gate: bool = False) -> DataFrame:
    """Rows (id, url, depth) with what a fetcher gives for each URL: (status, content_type, html), nulls on failure.

    With a ``delay`` all URLs of a host go to one task, which keeps that gap between them; ``at_once`` bounds the tasks. With the
    ``gate``, directories and spam are not asked for at all: their rows have nulls."""
    schema = "id long, url string, depth int, status int, content_type string, html string"
    asked = targets.select("id", "url", "depth", (urls.is_directory(F.col("url")) if gate else F.lit(False)).alias("skip"), urls.host(F.col("url")).alias("host"))
    if delay or at_once:
        asked = asked.repartition(at_once, "host") if at_once else asked.repartition("host")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, gap = resolve_function(fetcher), HostGap(delay, jitter)

        def one(url, skip, host):
            if skip:
                return None, None, None
            if delay:
                gap.wait(host)
            return fetch(url, None) or (None, None, None)

        for f in frames:
            got = [one(*x) for x in zip(f["url"], f["skip"], f["host"])]
            out = f[["id", "url", "depth"]].copy()
            out["status"], out["content_type"], out["html"] = (pd.Series(c, index=f.index, dtype=object) for c in zip(*got)) if got else (None, None, None)
            yield out

    return asked.mapInPandas(run, schema)


def holds_json(reply: str) -> bool:
    """Whether a reply is JSON: without a code fence, or its outermost object or list."""
    t = reply.strip()
    if t.startswith("```"):
        t = re.sub(r"```$", "", re.sub(r"^```[^\n]*\n", "", t)).strip()
    for part in (t, *(m.group() for p in (r"\{.*\}", r"\[.*\]") if (m := re.search(p, t, re.S)))):
        try:
            json.loads(part)
            return True
        except ValueError:
            continue
    return False


def ask_models(prompts: DataFrame, models: Sequence[str], caller: str, accept: Callable[[str], bool] = lambda reply: True) -> DataFrame:
    """Prompts (id, prompt) with the first model's reply that is not None and accepted: columns model and reply, null where all fail.

    ``caller`` names a function (model, prompt) -> text or None; a call that raises is one that fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = resolve_function(caller)

        def one(model, prompt):
            try:
                reply = call(model, prompt)
            except Exception:
                return None
            return reply if reply is not None and accept(reply) else None

        for f in frames:
            got = [next(((m, r) for m in models if (r := one(m, p)) is not None), (None, None)) for p in f["prompt"]]
            yield pd.DataFrame({"id": f["id"].to_numpy(), "model": [m for m, _ in got], "reply": [r for _, r in got]})

    return prompts.select("id", "prompt").mapInPandas(run, "id long, model string, reply string")


def with_attempts(outcome: Callable[[], str | None], attempts: int = 3, wait: Callable[[int], None] = lambda k: None) -> str | None:
    """Retry a call that may raise: ``wait`` is told the attempt; the last error is raised."""
    for k in range(attempts):
        try:
            return outcome()
        except Exception:
            if k + 1 == attempts:
                raise
            wait(k)
    return None


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages kept as JSON lines (url, status, content_type, html)."""
    return spark.read.schema("url string, status int, content_type string, html string").json(path).withColumn("depth", F.lit(0))
