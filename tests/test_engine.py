"""The engine over a store, from records to exports, and the crawl loop."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from leadweave import schemas
from leadweave.engine import Engine
from leadweave.operators import queue
from leadweave.settings import Settings
from leadweave.sources.connectors import HostGap, Sources, ask_models, fetch_pages, register, with_attempts

NOW = datetime(2025, 1, 1, 12, tzinfo=UTC)


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), clock=lambda: NOW)


def source(spark, query, wilaya, limit):
    rows = [("Pharmacie Centrale", "https://c.dz/", "+213555123456", 0), ("Pharmacie Centrale", "https://c.dz/", "+213555123456", 1), ("Garage Moderne", None, None, 2)]
    df = spark.createDataFrame(rows, "name string, website string, phone string, ord int")
    return df.select("name", F.lit("pharmacy").alias("industry"), F.lit(wilaya or "Oran").alias("wilaya"), "website", "phone", F.lit("mock").alias("source"), F.lit(0.0).alias("rating"), F.lit(0).alias("review_count"), F.timestamp_seconds(F.lit(1)).alias("last_updated"), "ord", F.concat_ws("|", "name", "website").alias("fingerprint"))


def test_from_discovery_to_export(spark, tmp_path):
    s = Sources()
    s.add("one", source)
    e = Engine(spark, str(tmp_path / "store"), sources=s, clock=lambda: NOW)
    assert e.discover("pharmacie", "Oran", 10) == {"discovered": 2, "inserted": 2, "updated": 0, "repeated": 0}
    assert e.discover("pharmacie", "Oran", 10)["updated"] == 2
    campaigns = e.campaigns().collect()
    assert {c["status"] for c in campaigns} == {"completed"} and len(campaigns) >= 1
    assert e.analyse() == 2 and e.analyse() == 0 and e.score() == 2
    leads = e.list_leads().collect()
    assert [x["name"] for x in leads] == ["Pharmacie Centrale", "Garage Moderne"] and {x["status"] for x in leads} == {"scored"}
    first = leads[0]["id"]
    e.set_status(first, "contacted")
    e.score()
    e.set_contact([first], True)
    e.set_tags(first, ["vip"])
    lead = e.lead(first).first()
    assert (lead["status"], lead["is_contact"], lead["tags"]) == ("contacted", True, ["vip"]) and lead["analysis"]["recommended_solutions"]
    assert [r["tag"] for r in e.tags().collect()] == ["vip"] and e.list_leads(tag="VIP").count() == 1
    assert [r["name"] for r in e.search("central*").collect()] == ["Pharmacie Centrale"]
    e.edit_lead(first, tags=["new"], name="Renamed", website="https://c.dz/")
    assert e.lead(first).first()["phone"] is None
    done = e.resolve()
    assert done["input_records"] == done["output_entities"] == 2 and e.entity_count() == 2
    assert e.lineage(first).first()["raw_record_id"] == first
    e.add_attachment(first, "a.pdf", "application/pdf", "/files/a.pdf")
    assert e.attachments(first).count() == 1
    e.delete_attachment(e.attachments(first).first()["id"])
    assert e.attachments(first).count() == 0
    assert spark.read.option("header", True).csv(e.export_leads_csv(str(tmp_path / "out"))).columns[:2] == ["id", "name"]
    assert spark.read.json(e.export_leads_json(str(tmp_path / "out"))).count() == 2 and spark.read.json(e.export_entities_json(str(tmp_path / "out"))).count() == 2
    assert e.delete_entities() == 2 and e.entity_count() == 0
    e.set_status([first], "rejected")
    assert e.stats().first()["total_leads"] == 1 and e.list_leads().count() == 1
    assert e.health()["faults"] == 0


def test_manual_leads(engine):
    engine.create_lead({"name": "Hand Made", "wilaya": "Oran", "industry": "x"}, ["a"])
    engine.create_lead({"name": "Hand Made", "wilaya": "Oran", "industry": "x", "address": "filled"}, ["b"])
    row = engine.view().first()
    assert (row["address"], row["status"], row["tags"], row["source"]) == ("filled", "verified", ["b"], "manual") and engine.view().count() == 1


def test_arguments(engine):
    for call in (lambda: engine.list_leads(limit=501), lambda: engine.seed([]), lambda: engine.check_query("{{x}}"), lambda: engine.check_query("a"), lambda: engine.set_status(1, "odd"), lambda: engine.discover("pharmacie", limit=0)):
        with pytest.raises(ValueError):
            call()


def test_bad_records_stay_out(engine, spark):
    rows = spark.createDataFrame([("ok", 3.0), ("", 1.0), ("x", 9.0)], "name string, rating double").withColumns({"wilaya": F.lit("w"), "phone": F.lit(None).cast("string"), "website": F.lit(None).cast("string")})
    assert engine.save_records(rows)["inserted"] == 1
    _, bad = schemas.split_valid(schemas.empty(spark, "lead_scores"), "lead_scores")
    assert bad.columns[-1] == "faults"


PAGE = "<html><head><title>Shop {0}</title></head><body>" + "<p>filler text here</p>" * 20 + '<a href="/next{0}">next</a><a href="https://other.dz/{0}">o</a><a href="#x">x</a>call 0555 12 34 5{0}</body></html>'


def get(url, params):
    """A fetcher without a network."""
    if "bad" in url:
        return 403, "text/html", "no"
    return 200, "text/html", PAGE.format(len(url) % 10)


def test_crawl(spark, engine):
    assert engine.seed(["https://a.dz/1", "https://a.dz/2", "https://bad.dz/", "nohost"]) == 3
    fetch = lambda claimed: fetch_pages(claimed, "tests.test_engine:get")
    done = engine.crawl_once(fetch)
    assert done == {"claimed": 2, "failed": 1, "queued": 2, "saved": 1}
    status = engine.crawler_status()
    assert status == {"running": False, "pending": 4, "processing": 0, "completed": 1, "failed": 0}
    again = engine.crawl_once(fetch)  # every host but the new one was just visited
    assert again["claimed"] == 1
    q = engine.tables.read("crawl_queue")
    stuck = q.limit(1).withColumns({"status": F.lit("processing"), "last_attempted": F.timestamp_seconds(F.lit(0))})
    assert queue.recover(stuck, engine._now()).first()["status"] == "pending"


def test_crawler_stream(spark, engine, tmp_path):
    import time

    engine.seed(["https://a.dz/1"])
    engine.start_crawler(lambda c: fetch_pages(c, "tests.test_engine:get"), str(tmp_path / "cp"), "1 second")
    for _ in range(90):
        time.sleep(1)
        if engine.tables.version("raw_records"):
            break
    assert engine.crawler_status()["running"]
    engine.stop_crawler()
    assert not engine.crawler_status()["running"] and engine.crawler_status()["completed"] >= 1


def results(url, params):
    return f'<a class="result__a" href="https://s{params["s"]}.dz/">Shop {params["q"]}</a>'


def answer(url, params):
    return '{"elements":[]}' if "kumi" in url else None


def reply(model, prompt):
    return None if model == "first" else f"{model}:{prompt}"


def test_connectors(spark):
    register(spark)
    pages = spark.read.format("search_pages").option("queries", "a\nb").option("pages", 2).option("fetcher", "tests.test_engine:results").load()
    assert {(r.query, r.page) for r in pages.collect()} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)} and pages.rdd.getNumPartitions() == 4
    assert json.loads(spark.read.format("map_responses").option("query", "q").option("fetcher", "tests.test_engine:answer").load().first()["json"]) == {"elements": []}
    asked = ask_models(spark.createDataFrame([(1, "p")], "id long, prompt string"), ["first", "second"], "tests.test_engine:reply").first()
    assert (asked["model"], asked["reply"]) == ("second", "second:p")
    waits = []
    with pytest.raises(ZeroDivisionError):
        with_attempts(lambda: 1 / 0, 3, waits.append)
    assert waits == [0, 1]


def test_settings_and_migrations(spark, tmp_path):
    s = Settings.from_environment({"LEADWEAVE_MODELS": " a, b,", "LEADWEAVE_MAX_BLOCK": "7", "LEADWEAVE_EDGE_THRESHOLD": "0.5"})
    assert (s.models, s.max_block, s.edge_threshold) == (("a", "b"), 7, 0.5)
    old = schemas.empty(spark, "lead_scores").drop("is_contact")
    assert "is_contact" in schemas.MIGRATIONS.upgrade(old, "lead_scores").columns
    assert schemas.current_version(schemas.MIGRATIONS.log(spark)).first()["version"] == 3 and schemas.current_version(schemas.MIGRATIONS.log(spark).limit(0)).first()["version"] == 0
    e = Engine(spark, str(tmp_path / "s"))
    for n in range(4):
        e.tables.write("domain_politeness", spark.createDataFrame([(f"h{n}",)], "domain string").withColumn("last_visited_at", F.current_timestamp()))
    assert e.tables.version("domain_politeness") == 4 and e.tables.read("domain_politeness").first()["domain"] == "h3" and e.tables.compact("domain_politeness") == 5


def few_results(url, params):
    return results(url, params) if params["s"] < 60 else "<p>nothing</p>"


def test_search_pages_stop(spark):
    register(spark)
    load = lambda rows: spark.read.format("search_pages").options(queries="a", pages=9, rows=rows, fetcher="tests.test_engine:few_results").load()
    assert sorted(r.page for r in load(30).collect()) == [0, 1] and [r.page for r in load(1).collect()] == [0]


def test_host_gap():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    gap = HostGap(2.0, clock=lambda: now[0], sleep=sleep)
    for host in ("a", "b", "a", "a"):
        gap.wait(host)
    assert slept == [2.0, 2.0]


def test_gate_and_gap_of_fetches(spark):
    urls = [(1, "https://a.dz/1", 0), (2, "https://www.yelp.com/x", 0), (3, "https://a.dz/2", 0)]
    got = fetch_pages(spark.createDataFrame(urls, "id long, url string, depth int"), "tests.test_engine:get", delay=0.01, jitter=0.5, at_once=2, gate=True).collect()
    assert {r.id: r.status for r in got} == {1: 200, 2: None, 3: 200}


def model(name, prompt):
    if "Garage" in prompt:
        raise ConnectionError(name)
    return "busy" if name == "m1" else '{"digital_presence_score": 88, "pain_points": ["x"]}'


def no_model(name, prompt):
    raise AssertionError("the cache has it" if "Pharmacie" in prompt else name)


def test_analyse_by_models(spark, tmp_path):
    s = Sources()
    s.add("one", source)
    e = Engine(spark, str(tmp_path / "store"), Settings(models=("m1", "m2")), s, lambda: NOW)
    assert [r["discovered"] for r in e.discover_many(["pharmacie", "garage"], "Oran", 10)] == [2, 2]
    assert e.analyse(caller="tests.test_engine:model") == 2
    rows = lambda: {(r["analysis_model"], r["from_cache"], r["digital_presence_score"] == 88) for r in e.tables.read("analyses").collect()}
    assert rows() == {("m2", False, True), ("heuristic-fallback", False, False)}
    assert e.analyse(again=True, caller="tests.test_engine:no_model") == 2 and rows() == {("m2", True, True), ("heuristic-fallback", False, False)}
    assert e.clear_replies() == 1 and e.clear_replies() == 0
    assert e.analyse(again=True, caller="tests.test_engine:no_model") == 2 and {r[0] for r in rows()} == {"heuristic-fallback"}


def test_failed_campaign(spark, tmp_path):
    def broken(*_):
        raise OSError("down")

    s = Sources()
    s.add("broken", broken)
    e = Engine(spark, str(tmp_path / "store"), sources=s, clock=lambda: NOW)
    with pytest.raises(OSError):
        e.discover("pharmacie")
    assert [c["status"] for c in e.campaigns().collect()] == ["failed"]


def test_failed_rounds_are_counted(spark, engine, tmp_path):
    import time

    engine.seed(["https://a.dz/1"])

    def fail(claimed):
        raise OSError("down")

    engine.start_crawler(fail, str(tmp_path / "cp"), "1 second")
    for _ in range(60):
        time.sleep(1)
        if engine.crawler_counters()["errors"]:
            break
    assert engine.crawler_status()["running"] and engine.crawler_counters()["errors"] >= 1
    engine.stop_crawler()
