"""Queries over campaigns, attachments, entities, enrichment, social pages, proxies and the reply cache, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadweave import schemas
from leadweave.functions import dates, urls, values
from leadweave.functions import html as H
from leadweave.functions.text import cache_key
from leadweave.operators import discovery, leads, proxies, queue, resolve, scoring, store
from leadweave.plans import relations as R
from leadweave.plans.lead_queries import _CC, parts, view
from leadweave.plans.lead_queries import _sql as _view_sql
from leadweave.plans.relations import with_tables
from leadweave.sources import catalogues, sinks
from leadweave.sources.connectors import ask_models, holds_json

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("campaigns", f"SELECT * FROM (VALUES ('pharmacie', 'Oran', 'completed', 7, 5), ('garage', NULL, 'pending', 0, 0)) t(query, wilaya, status, discovered_qty, saved_qty) WHERE {R.NOW} > 0")
def _(spark, d):
    c = store.add_campaign(schemas.empty(spark, "discovery_campaigns"), "pharmacie", "Oran", 10, R.now())
    c = store.add_campaign(c, "garage", None, 10, R.now())
    change = c.filter("query = 'pharmacie'").select("id", F.lit("completed").alias("status"), F.lit(7).alias("discovered_qty"), F.lit(5).alias("saved_qty"))
    return leads.newest(store.set_campaign(c, change, R.now()), 10).select("query", "wilaya", "status", "discovered_qty", "saved_qty")


@query("attachments", with_tables("raw_records", sql="SELECT id, 'f' || id AS filename FROM raw_records WHERE id % 10 = 3 AND id % 4 <> 1"))
def _(spark, d):
    a = R.raw_records(spark, d).select("id", (F.col("id") % 10).alias("raw_record_id"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), "created_at")
    return leads.attachments_of(store.without(a, a.filter("id % 4 = 1")), 3).select("id", "filename")


@query("resolution_summary", _CC + "SELECT (SELECT count(*) FROM rec) AS input_records, count(DISTINCT cluster) AS output_entities, round(1 - count(DISTINCT cluster) / (SELECT count(*) FROM rec), 6)::DOUBLE AS compression FROM cl")
def _(spark, d):
    p = parts(spark, d)
    return resolve.resolution_summary(p, resolve.clusters(p).select("cluster").distinct()).withColumn("compression", F.round("compression", 6))


@query("entities_list", _CC + ", m AS (SELECT cluster AS id, CASE WHEN count(*) = 1 THEN 1.0 ELSE round(least(0.99, 0.7 + 0.1 * count(*)), 6) END::DOUBLE AS confidence FROM cl GROUP BY cluster) SELECT id, confidence FROM m WHERE confidence >= 0.95 ORDER BY confidence DESC, id LIMIT 60")
def _(spark, d):
    e = resolve.resolve(parts(spark, d)).withColumn("last_resolved_at", R.now())
    return leads.list_entities(e, 0.95, wilaya="Y", industry="x", limit=60).select("id", F.round("confidence", 6).alias("confidence"))


@query("enrich_records", "SELECT * FROM (VALUES (1, 'Chez A', '1 rue, Oran', 'a@a.dz', '+213555123456', 2), (2, 'kept', NULL, 'own@b.dz', NULL, 0)) t(id, name, address, email, phone, socials)")
def _(spark, d):
    from leadweave.plans.text_queries import fx_html

    rows = [(1, "kept", None, "https://a.dz/p", None, None, ["https://x.com/old"]), (2, "kept", None, "https://b.dz/", None, "own@b.dz", [])]
    r = spark.createDataFrame(rows, "id int, name string, address string, website string, phone string, email string, social_media_handles array<string>").withColumn("phone_metadata", F.lit(None).cast(schemas.TABLES["raw_records"]["phone_metadata"].dataType))
    pages = fx_html(spark).select(F.col("url").alias("website"), H.profile(F.col("html"), H.json_ld(F.col("html"))).alias("p"))
    return discovery.enrich(r, pages).select("id", "name", "address", "email", "phone", F.size("social_media_handles").alias("socials"))


@query("social_profiles", "SELECT * FROM (VALUES ('Shop P', '+213555123456', 'https://www.facebook.com/p', 'Social Profile')) t(name, phone, website, industry)")
def _(spark, d):
    long = " " * 1600
    rows = [(1, "https://www.facebook.com/p", '<title>x</title><meta property="og:title" content="Shop P"><meta property="og:description" content="tel 0555 12 34 56">' + long), (2, "https://www.facebook.com/q", "short"), (3, "https://a.dz/", "<title>not social</title>" + long), (4, "https://tiktok.com/@x", "<title>T</title>please log in" + long)]
    return discovery.records_of_profiles(spark.createDataFrame(rows, "id int, url string, html string"), R.now()).select("name", "phone", "website", "industry")


@query("proxy_pick", "SELECT * FROM (VALUES (1, 'b', 90.0::DOUBLE, 'HEALTHY'), (2, 'a', 100.0, 'RECOVERING')) t(k, url, health, state)")
def _(spark, d):
    some = spark.createDataFrame([("a", 20.0, "UNHEALTHY"), ("b", 90.0, "HEALTHY"), ("c", 50.0, "DEGRADED")], "url string, health double, state string")
    return proxies.healthiest(some).select(F.lit(1).alias("k"), "*").unionByName(proxies.healthiest(some.filter("health < 30")).select(F.lit(2).alias("k"), "*"))


@query("cached_replies", with_tables("raw_records", sql="SELECT id, CASE WHEN id % 2 = 0 THEN name END AS reply FROM raw_records"))
def _(spark, d):
    r = R.raw_records(spark, d).select("id", F.lit("m").alias("model"), F.concat(F.col("id").cast("string"), F.lit(":"), "name").alias("prompt"), "name")
    cache = sinks.cache_rows(r.filter("id % 2 = 0").select("model", "prompt", F.col("name").alias("reply")))
    return scoring.with_cached_replies(r.select("id", "model", "prompt"), cache).select("id", "reply")


@query("map_query", "SELECT * FROM (VALUES (1, 'pharmacie', true), (2, 'zzz', false), (3, 'avocat', false)) t(id, query, asked)")
def _(spark, d):
    f = spark.createDataFrame([(1, "pharmacie", "Oran"), (2, "zzz", "Oran"), (3, "avocat", "")], "id int, query string, region string")
    return f.select("id", "query", F.coalesce(catalogues.map_query(F.col("query"), F.col("region")).contains("node[amenity=pharmacy](area.searchArea);way["), F.lit(False)).alias("asked"))


@query("seed_urls", with_tables("crawl_queue", sql="SELECT DISTINCT 'https://html.duckduckgo.com/html/?q=' || replace(wilaya, ' ', '+') AS url, 10 AS priority FROM (SELECT 'Nation ' || c_nationkey AS wilaya FROM customer)"))
def _(spark, d):
    targets = R.raw_records(spark, d).select(queue.search_seed(F.col("wilaya")).alias("url"))
    return queue.seeds(R.crawl_queue(spark, d), targets, R.now()).select("url", "priority")


@query("valid_records", with_tables("raw_records", sql="SELECT id, CASE WHEN id % 9 = 0 THEN 'rating' WHEN id % 9 = 1 THEN 'name' ELSE '' END AS faults FROM raw_records"))
def _(spark, d):
    r = R.raw_records(spark, d).withColumn("rating", F.when(F.col("id") % 9 == 0, 7.0).otherwise(F.col("rating"))).withColumn("name", F.when(F.col("id") % 9 == 1, "  ").otherwise(F.col("name")))
    good, bad = schemas.split_valid(r, "raw_records")
    return good.select("id", F.lit("").alias("faults")).unionByName(bad.select("id", F.concat_ws("|", "faults").alias("faults")))


@query("prompt_keys", with_tables("raw_records", sql="SELECT id, sha256('m::' || name) AS key FROM raw_records"))
def _(spark, d):
    return R.raw_records(spark, d).select("id", cache_key(F.lit("m"), F.col("name")).alias("key"))


@query("entity_by_id", _CC + "SELECT cluster AS id, count(*) AS members FROM cl WHERE cluster = (SELECT min(cluster) FROM cl) GROUP BY cluster")
def _(spark, d):
    e = resolve.resolve(parts(spark, d))
    first = e.agg(F.min("id")).first()[0]
    return leads.by_id(e, first).select("id", F.size("raw_record_ids").cast("long").alias("members"))


@query("same_site", """
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, host <> '' AND host = regexp_replace(host, '^m\\.', '') AS same FROM h""")
def _(spark, d):
    """Whether a page's host is the one that its address has without a mobile prefix."""
    p = R.table(spark, d, "pages")
    return p.select("page_id", urls.same_site(F.col("url"), F.regexp_replace("url", r"://(www\.)?m\.", "://")).alias("same"))


@query("timestamps", "SELECT event_id, epoch_us(ts)::DOUBLE AS at, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, NULL::DOUBLE AS fault FROM events")
def _(spark, d):
    """ISO text of every event's time and back, its export stamp, and null for text that is no time."""
    e = R.table(spark, d, "events").withColumn("text", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    at = dates.iso(F.col("text"))
    return e.select("event_id", F.unix_micros(at).cast("double").alias("at"), dates.stamp(at).alias("stamp"), F.unix_micros(dates.iso(F.concat(F.lit("x"), "text"))).cast("double").alias("fault"))


@query("spam_extra_hosts", "SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '(^|\\.)example\\.org$') AS spam FROM pages")
def _(spark, d):
    """The default lists extended by a host; the tables' addresses meet none of the default ones."""
    return R.table(spark, d, "pages").select("page_id", urls.is_directory(F.col("url"), hosts=("example.org",)).alias("spam"))


@query("schema_version", f"SELECT 3 AS version, count(*) AS rows, count(*) FILTER (WHERE calculated = 'older') AS filled FROM (SELECT c_custkey, 'older' AS calculated FROM customer) WHERE {R.NOW} > 0")
def _(spark, d):
    """Records of an old schema upgraded by the ordered migrations, and the version that they reach."""
    old = R.raw_records(spark, d).drop("calculated_age_class", "relative_age_hint")
    new = schemas.MIGRATIONS.upgrade(old, "raw_records")
    version = schemas.current_version(schemas.MIGRATIONS.log(spark))
    return new.agg(F.count("*").alias("rows"), F.count_if(F.col("calculated_age_class") == "older").alias("filled")).crossJoin(F.broadcast(version)).select("version", "rows", "filled")


@query("leads_json", _view_sql("SELECT id, name, status, priority_score::DOUBLE AS priority_score, analyzed FROM lead_view"))
def _(spark, d):
    """The JSON of every exported lead, read back."""
    j = leads.detail(view(spark, d)).select(F.to_json(F.struct("*")).alias("j"))
    get = lambda path: F.get_json_object("j", path)
    return j.select(get("$.id").cast("long").alias("id"), get("$.name").alias("name"), get("$.status").alias("status"), get("$.priority_score").cast("double").alias("priority_score"), get("$.analysis").isNotNull().alias("analyzed"))


@query("entities_json", _CC + "SELECT cluster AS id, count(*) AS members FROM cl GROUP BY cluster")
def _(spark, d):
    """The JSON of every exported entity, read back."""
    j = resolve.resolve(parts(spark, d)).select(F.to_json(F.struct("*")).alias("j"))
    return j.select(F.get_json_object("j", "$.id").cast("long").alias("id"), F.json_array_length(F.get_json_object("j", "$.raw_record_ids")).cast("long").alias("members"))


def canned_reply(model: str, prompt: str) -> str | None:
    """A caller for the query below, by the id in the prompt: the first model fails, talks, or answers; the second one answers some."""
    i = int(prompt.rsplit('"id":', 1)[1].split(",")[0].rstrip("}"))
    answer = '{"digital_presence_score": %d, "pain_points": ["p"], "recommended_solutions": [{"service_name": "s", "priority": 3}, {"priority": 1}]}' % (i % 120)
    if i % 6 == 4:
        raise ConnectionError(model)
    if i % 6 == 3:
        return f"```json\n{answer}\n```" if model == "m1" else None
    return "no JSON" if model == "m1" else f"Here it is: {answer}" if i % 6 == 2 else None


@query("model_chain", with_tables("raw_records", sql="""
@ c AS (SELECT id, CASE id % 6 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' WHEN 2 THEN 'm2' WHEN 3 THEN 'm1' END AS model, id % 6 < 2 AS held FROM raw_records),
u AS (SELECT id, model, held, CASE WHEN held THEN id % 101 ELSE id % 120 END AS presence FROM c WHERE model IS NOT NULL)
SELECT r.id, coalesce(u.model, 'heuristic-fallback') AS model, coalesce(u.held, false) AS from_cache, u.presence AS presence, CASE WHEN u.id IS NULL THEN NULL WHEN u.held THEN 0 ELSE 1 END AS solutions
FROM raw_records r LEFT JOIN u ON u.id = r.id AND u.presence <= 100"""))
def _(spark, d):
    """Analyses by cached replies, then by the models in their order, then by rule; presence and solutions of those by a model."""
    r, models = R.raw_records(spark, d), ("m1", "m2")
    asked = scoring.prompts(r, ("name", "id"))
    known = asked.filter("id % 6 < 2").select(F.when(F.col("id") % 6 == 0, "m1").otherwise("m2").alias("model"), "prompt", F.concat(F.lit('{"digital_presence_score": '), F.col("id") % 101, F.lit("}")).alias("reply"))
    cache = sinks.cache_rows(known).withColumn("batch", F.lit("before"))
    missing = asked.join(scoring.replies(asked, models, cache).select("id"), "id", "left_anti")
    got = ask_models(missing, models, f"{__name__}:canned_reply", holds_json).filter("reply IS NOT NULL").join(asked, "id")
    cache = cache.unionByName(sinks.cache_rows(got).withColumn("batch", F.lit("now")))
    a = scoring.analyse_by_models(r, scoring.replies(asked, models, cache), "now", R.now())
    by_model = F.col("analysis_model") != scoring.MODEL
    return a.select(F.col("raw_record_id").alias("id"), F.col("analysis_model").alias("model"), "from_cache", F.when(by_model, F.col("digital_presence_score")).alias("presence"), F.when(by_model, F.size("recommended_solutions")).alias("solutions"))


@query("backoff_jitter", "SELECT event_id, round(greatest(0.1, least(60.0, 2.0 * pow(2, event_id % 7)) * (1 + 0.25 * (2 * (event_id % 1000) / 1000.0 - 1)))::DOUBLE, 6) AS wait FROM events")
def _(spark, d):
    """The wait before each event's retry, its jitter drawn from the event's number."""
    e = R.table(spark, d, "events").select("event_id")
    return e.select("event_id", F.round(values.backoff(F.col("event_id") % 7, jitter=0.25, unit=(F.col("event_id") % 1000) / 1000), 6).alias("wait"))
