"""The engine's face: one method for each thing a user asks of it, over a store of snapshots."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave import schemas
from leadweave.functions.text import sanitised_query
from leadweave.operators import discovery, leads, queue, resolve, scoring, search, store
from leadweave.settings import Settings
from leadweave.sources import catalogues, sinks
from leadweave.sources.connectors import Sources, ask_models, holds_json
from leadweave.streaming import crawl


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} has to be between {low} and {high}")


class Engine:
    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, sources: Sources | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.settings, self.sources, self.clock = spark, settings or Settings(), sources or Sources(), clock
        self.tables = store.Store(spark, path)
        self.crawler = None
        self.replies = f"{path.rstrip('/')}/model_replies"
        self.counters = {"rounds": 0, "errors": 0, "claimed": 0, "failed": 0, "queued": 0, "saved": 0}

    def _now(self):
        return F.timestamp_micros(F.lit(int(self.clock().timestamp() * 1_000_000)))

    def _t(self, name: str) -> DataFrame:
        return self.tables.read(name)

    # --- discovery ---

    def check_query(self, query: str) -> str:
        """The sanitised query; ValueError if it is empty, forbidden, or not of 2 to 200 characters."""
        _within("length of the query", len(query or ""), 2, 200)
        clean = self.spark.range(1).select(sanitised_query(F.lit(query)).alias("q")).first()["q"]
        if clean is None:
            raise ValueError("the query is empty or forbidden")
        return clean

    def expand(self, query: str) -> list[str]:
        row = discovery.expand_queries(self.spark.createDataFrame([(query,)], "query string")).first()
        return list(row["variants"] or [])

    def discover(self, query: str, wilaya: str | None = None, limit: int = 30) -> dict:
        """Ask all sources for all variants of a query, save what is new, and record the campaign."""
        query = self.check_query(query)
        _within("limit", limit, 1, 200)
        now = self._now()
        campaigns = store.add_campaign(self._t("discovery_campaigns"), query, wilaya, limit, now)
        self.tables.write("discovery_campaigns", campaigns)
        campaign = campaigns.orderBy(F.col("created_at").desc()).first()["id"]

        def close(status: str, discovered: int, saved: int) -> None:
            change = self.spark.createDataFrame([(campaign, status, discovered, saved)], "id long, status string, discovered_qty int, saved_qty int")
            self.tables.write("discovery_campaigns", store.set_campaign(self._t("discovery_campaigns"), change, self._now()))

        try:
            found = [df for v in self.expand(query) for df in self.sources.records(self.spark, v, wilaya, discovery.over_fetch(limit))]
            result = self.save_records(discovery.discover(found, limit)) if found else {"discovered": 0, "inserted": 0, "updated": 0, "repeated": 0}
        except Exception:
            close("failed", 0, 0)
            raise
        close("completed", result["discovered"], result["inserted"] + result["updated"])
        return result

    def discover_many(self, queries: list[str], wilaya: str | None = None, limit: int = 20) -> list[dict]:
        """Discovery of one query after the other."""
        return [self.discover(q, wilaya, limit) for q in queries]

    def campaigns(self, limit: int = 10) -> DataFrame:
        return leads.newest(self._t("discovery_campaigns"), limit)

    def save_records(self, records: DataFrame) -> dict:
        """Upsert records; those that break a check are left out."""
        given = records if "fingerprint" in records.columns else store.with_fingerprint(records)
        missing = [f for f in schemas.TABLES["raw_records"] if f.name not in given.columns]
        whole = given.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]).select(*[F.col(f.name).cast(f.dataType) for f in schemas.TABLES["raw_records"]])
        good, _ = schemas.split_valid(schemas.with_defaults(whole, "raw_records"), "raw_records")
        good = good.cache()
        known = self._t("raw_records")
        result = store.save_summary(known, good).first().asDict()
        self.tables.write("raw_records", store.save_records(known, good))
        good.unpersist()
        return result

    # --- leads ---

    def view(self) -> DataFrame:
        return leads.lead_view(self._t("raw_records"), self._t("analyses"), self._t("lead_scores"))

    def list_leads(self, wilaya=None, industry=None, age_class=None, min_score=0.0, is_contact=None, tag=None, sort_by=None, sort_order="desc", limit=100, offset=0) -> DataFrame:
        _within("limit", limit, 1, 500)
        _within("min_score", min_score, 0, 100)
        where = leads.LeadFilter(wilaya, industry, age_class, min_score, is_contact, tag)
        return leads.summary(leads.list_leads(self.view(), where, sort_by, sort_order, limit, offset))

    def lead(self, id_: int) -> DataFrame:
        return leads.detail(leads.by_id(self.view(), id_))

    def search(self, term: str, is_contact: bool | None = None, limit: int = 50) -> DataFrame:
        return search.search_leads(self.view(), term, is_contact, limit)

    def tags(self) -> DataFrame:
        return leads.distinct_tags(self._t("lead_scores"))

    def vocabulary(self) -> DataFrame:
        return leads.vocabulary(self._t("raw_records"))

    def stats(self) -> DataFrame:
        return leads.stats(self._t("raw_records"), self._t("analyses"), self._t("lead_scores"), self._t("resolved_entities"))

    def create_lead(self, record: dict, tags: list[str] | None = None) -> None:
        row = {f.name: record.get(f.name) for f in schemas.TABLES["raw_records"]} | {"source": "manual"}
        df = store.with_fingerprint(schemas.with_defaults(self.spark.createDataFrame([tuple(row.values())], schemas.TABLES["raw_records"]), "raw_records"))
        now = self._now()
        df = df.withColumns({c: F.coalesce(c, now) for c in ("discovered_at", "last_updated", "created_at")}).withColumn("tags", F.lit(tags or []).cast("array<string>"))
        records, scores = store.save_manual(self._t("raw_records"), self._t("lead_scores"), df, now)
        self.tables.write("raw_records", records)
        self.tables.write("lead_scores", scores)

    def edit_lead(self, id_: int, tags: list[str] | None = None, **values: str | None) -> None:
        """Overwrite name, address, website, phone and email; what is not given becomes null."""
        row = self.spark.createDataFrame([(id_, *[values.get(c) for c in ("name", "address", "website", "phone", "email")])], "id long, name string, address string, website string, phone string, email string")
        self.tables.write("raw_records", store.edit_records(self._t("raw_records"), row))
        if tags is not None:
            self.set_tags(id_, tags)

    def _ids(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "raw_record_id long")

    def set_status(self, ids: int | list[int], status: str) -> None:
        if status not in schemas.STATUSES:
            raise ValueError(f"no such status: {status}")
        many = ids if isinstance(ids, list) else [ids]
        if many:
            self.tables.write("lead_scores", store.set_fields(self._t("lead_scores"), self._ids(many), self._now(), status=status, touch=isinstance(ids, list)))

    def set_contact(self, ids: int | list[int], is_contact: bool) -> None:
        many = ids if isinstance(ids, list) else [ids]
        if many:
            self.tables.write("lead_scores", store.set_fields(self._t("lead_scores"), self._ids(many), self._now(), is_contact=is_contact))

    def set_tags(self, id_: int, tags: list[str]) -> None:
        row = self.spark.createDataFrame([(id_, tags)], "raw_record_id long, tags array<string>")
        self.tables.write("lead_scores", store.set_tags(self._t("lead_scores"), row, self._now()))

    def add_attachment(self, id_: int, filename: str, mime_type: str, path: str) -> None:
        """The attachment's row; its bytes stay where they are."""
        row = self.spark.range(1).select(store.new_id(F.lit(id_), F.lit(path)).alias("id"), F.lit(id_).cast("long").alias("raw_record_id"), F.lit(filename).alias("filename"), F.lit(mime_type).alias("mime_type"), F.lit(path).alias("file_path"), self._now().alias("created_at"))
        self.tables.write("lead_attachments", self._t("lead_attachments").unionByName(row))

    def attachments(self, id_: int) -> DataFrame:
        return leads.attachments_of(self._t("lead_attachments"), id_)

    def delete_attachment(self, attachment_id: int) -> None:
        self.tables.write("lead_attachments", self._t("lead_attachments").filter(F.col("id") != attachment_id))

    # --- analyses and scores ---

    def analyse(self, again: bool = False, ids: list[int] | None = None, caller: str | None = None) -> int:
        """Analyse pending records, all ``again``, or some ``ids``; returns how many.

        With models in the settings and a ``caller`` (``module:function``), a cached reply counts first, then the models in their order;
        records that no model answers are analysed by rule. Replies are stored before they are used, so none is asked for twice."""
        todo = scoring.pending(self._t("raw_records"), self._t("analyses"), again or ids is not None)
        if ids is not None:
            todo = todo.join(self._ids(ids).withColumnRenamed("raw_record_id", "id"), "id", "left_semi")
        made = (self._analyse_by_models(todo, caller) if caller and self.settings.models else scoring.analyse(todo, self._now())).cache()
        n = made.count()
        analyses, scores = store.attach_analyses(self._t("analyses"), self._t("lead_scores"), made, self._now())
        self.tables.write("analyses", analyses)
        self.tables.write("lead_scores", scores)
        made.unpersist()
        return n

    def _analyse_by_models(self, todo: DataFrame, caller: str) -> DataFrame:
        models, batch = self.settings.models, uuid4().hex
        asked = scoring.prompts(todo)
        held = scoring.replies(asked, models, sinks.read_cache(self.spark, self.replies))
        answers = ask_models(asked.join(held.select("id"), "id", "left_anti"), models, caller, holds_json).filter("reply IS NOT NULL")
        sinks.write_cache(answers.join(asked, "id").select("model", "prompt", "reply"), self.replies, batch)
        return scoring.analyse_by_models(todo, scoring.replies(asked, models, sinks.read_cache(self.spark, self.replies)), batch, self._now())

    def clear_replies(self) -> int:
        return sinks.clear_cache(self.spark, self.replies)

    def score(self, ids: list[int] | None = None, points=None) -> int:
        v = self.view()
        if ids is not None:
            v = v.join(self._ids(ids).withColumnRenamed("raw_record_id", "id"), "id", "left_semi")
        made = scoring.score(v, self._now(), points).cache()
        n = made.count()
        self.tables.write("lead_scores", store.save_scores(self._t("lead_scores"), made))
        made.unpersist()
        return n

    # --- entities ---

    def resolve(self, newest: int | None = None) -> dict:
        """Rebuild all entities and links from the records."""
        records = self._t("raw_records")
        s = self.settings
        cfg = resolve.ResolverConfig(max_block=s.max_block, name_threshold=s.name_threshold, edge_threshold=s.edge_threshold)
        entities = resolve.resolve(records, cfg, newest).withColumn("last_resolved_at", self._now()).cache()
        done = resolve.resolution_summary(records if newest is None else records.limit(newest), entities).first().asDict()
        merged, links = store.save_entities(schemas.empty(self.spark, "resolved_entities"), schemas.empty(self.spark, "entity_links"), entities, self._now())
        self.tables.write("resolved_entities", merged)
        self.tables.write("entity_links", links)
        entities.unpersist()
        return done

    def entities(self, min_confidence=0.0, wilaya=None, industry=None, limit=100, offset=0) -> DataFrame:
        return leads.list_entities(self._t("resolved_entities"), min_confidence, wilaya, industry, limit, offset)

    def entity(self, id_: int) -> DataFrame:
        return leads.by_id(self._t("resolved_entities"), id_)

    def lineage(self, entity_id: int) -> DataFrame:
        return leads.lineage(self._t("entity_links"), self._t("raw_records"), entity_id)

    def entity_count(self) -> int:
        return self._t("resolved_entities").count()

    def delete_entities(self) -> int:
        self.tables.clear("entity_links")
        return self.tables.clear("resolved_entities")

    # --- crawl ---

    def seed(self, urls: list[str]) -> int:
        _within("number of seeds", len(urls), 1, 50)
        q = self._t("crawl_queue")
        fresh = queue.seeds(q, self.spark.createDataFrame([(u,) for u in urls], "url string"), self._now()).cache()
        n = fresh.count()
        self.tables.write("crawl_queue", q.unionByName(fresh))
        fresh.unpersist()
        return n

    def seed_queries(self, queries: list[str]) -> int:
        """Seeds for all variants of the queries, in groups of as many as a call may bring."""
        urls = [f"https://html.duckduckgo.com/html/?q={v.replace(' ', '+')}" for q in queries for v in self.expand(q)]
        return sum(self.seed(urls[lo : lo + 50]) for lo in range(0, len(urls), 50))

    def crawl_once(self, fetch: crawl.Fetch, limit: int | None = None) -> dict[str, int]:
        done = crawl.crawl_step(self.tables, fetch, self._now(), limit)
        self._count(done)
        return done

    def _count(self, done: dict[str, int]) -> None:
        for k, v in ({"rounds": 1} | done).items():
            self.counters[k] += v

    def start_crawler(self, fetch: crawl.Fetch, checkpoint: str, interval: str = "5 seconds", limit: int | None = None) -> None:
        if self.crawler is None or not self.crawler.isActive:
            self.crawler = crawl.run_crawler(self.tables, fetch, checkpoint, interval, limit, self._count)

    def stop_crawler(self) -> None:
        if self.crawler is not None:
            crawl.stop(self.crawler)

    def crawler_status(self) -> dict:
        rows = {r["status"]: r["n"] for r in queue.status_counts(self._t("crawl_queue")).collect()}
        return {"running": bool(self.crawler is not None and self.crawler.isActive), **{s: rows.get(s, 0) for s in schemas.QUEUE_STATES}}

    def crawler_counters(self) -> dict[str, int]:
        """Rounds, errors and rows since the engine was made."""
        return dict(self.counters)

    # --- exports and health ---

    def export_leads_csv(self, folder: str, limit: int = 1000) -> str:
        return sinks.export_leads_csv(self.view(), folder, self.clock(), limit)

    def export_leads_json(self, folder: str, limit: int = 1000) -> str:
        return sinks.export_leads_json(self.view(), folder, self.clock(), limit)

    def export_entities_json(self, folder: str, limit: int = 1000) -> str:
        return sinks.export_entities_json(self._t("resolved_entities"), folder, self.clock(), limit)

    def health(self) -> dict:
        return {"tables": {t: self.tables.version(t) for t in schemas.TABLES}, "faults": self.tables.faults("raw_records", "fingerprint").count()}

    def region_names(self) -> DataFrame:
        return catalogues.region_names(self.spark)
