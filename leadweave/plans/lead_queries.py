"""Queries over the lead read model and its upserts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.operators import leads, resolve, scoring, search, store
from leadweave.plans import relations as R
from leadweave.plans.relations import with_tables
from leadweave.sources import sinks

VIEW = """
@ lead_view AS (
  SELECT r.*, a.raw_record_id IS NOT NULL AS analyzed,
         CASE WHEN a.raw_record_id IS NOT NULL THEN coalesce(nullif(a.digital_presence_score, 0), 50) END AS digital_presence_score, a.solution_values,
         coalesce(s.priority_score, 0.0) AS priority_score, coalesce(s.status, 'discovered') AS status, s.tags, coalesce(s.is_contact, false) AS is_contact
  FROM raw_records r LEFT JOIN analyses a ON a.raw_record_id = r.id LEFT JOIN lead_scores s ON s.raw_record_id = r.id)
"""
THREE = ("raw_records", "analyses", "lead_scores")


def _sql(body: str) -> str:
    return with_tables(*THREE, sql=VIEW + body)


def view(spark, d) -> DataFrame:
    return leads.lead_view(R.raw_records(spark, d), R.analyses(spark, d), R.lead_scores(spark, d))


def _short(df: DataFrame) -> DataFrame:
    """Plain columns of a lead, arrays as text."""
    tags = F.concat_ws("|", "tags")
    return df.select("id", "name", "industry", "wilaya", "website", "phone", (F.coalesce(F.size("social_media_handles"), F.lit(0)) > 0).alias("has_social"), "rating", "review_count", "source", "priority_score", "status", tags.alias("tags"), "is_contact", F.col("calculated_age_class").alias("freshness"), F.col("digital_presence_score").cast("double").alias("digital_presence_score"))


SHORT = "id, name, industry, wilaya, website, phone, coalesce(len(social_media_handles), 0) > 0 AS has_social, rating, review_count, source, priority_score, status, coalesce(array_to_string(tags, '|'), '') AS tags, is_contact, calculated_age_class AS freshness, digital_presence_score::DOUBLE AS digital_presence_score"

Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("lead_view", _sql(f"SELECT {SHORT} FROM lead_view"))
def _(spark, d):
    return _short(view(spark, d))


@query("leads_filtered", _sql(f"SELECT {SHORT} FROM lead_view WHERE priority_score >= 5 AND status <> 'rejected' AND lower(wilaya) = 'nation 7' AND lower(industry) LIKE '%mach%'"))
def _(spark, d):
    return _short(view(spark, d).filter(leads.LeadFilter(wilaya="NATION 7", industry="MACH", min_score=5).condition()))


@query("leads_by_age", _sql(f"SELECT {SHORT} FROM lead_view WHERE status <> 'rejected' AND calculated_age_class = 'day'"))
def _(spark, d):
    return _short(view(spark, d).filter(leads.LeadFilter(age_class="day").condition()))


@query("leads_contacts", _sql(f"SELECT {SHORT} FROM lead_view WHERE status <> 'rejected' AND is_contact"))
def _(spark, d):
    return _short(view(spark, d).filter(leads.LeadFilter(is_contact=True).condition()))


@query("leads_by_tag", _sql(f"SELECT {SHORT} FROM lead_view WHERE status <> 'rejected' AND len(list_filter(tags, lambda t: lower(t) = 'vip')) > 0"))
def _(spark, d):
    return _short(view(spark, d).filter(leads.LeadFilter(tag="Vip").condition()))


@query("leads_page", _sql(f"SELECT {SHORT} FROM lead_view WHERE status <> 'rejected' ORDER BY priority_score DESC NULLS LAST, created_at DESC LIMIT 50 OFFSET 25"))
def _(spark, d):
    return _short(leads.list_leads(view(spark, d), limit=50, offset=25))


@query("leads_sorted", _sql(f"SELECT {SHORT} FROM lead_view WHERE status <> 'rejected' ORDER BY phone ASC NULLS FIRST, created_at DESC LIMIT 40"))
def _(spark, d):
    return _short(leads.list_leads(view(spark, d), sort_by="phone", order="asc", limit=40))


@query("lead_by_id", _sql(f"SELECT {SHORT} FROM lead_view WHERE id = 77"))
def _(spark, d):
    return _short(leads.by_id(view(spark, d), 77))


@query("lead_details", _sql("SELECT id, status, digital_presence_score::DOUBLE AS digital_presence_score, CASE WHEN analyzed THEN round(coalesce(list_sum(solution_values), 0), 2)::DOUBLE END AS total_value, address, email, latitude, longitude, epoch(discovered_at)::BIGINT AS discovered FROM lead_view"))
def _(spark, d):
    x = leads.detail(view(spark, d))
    return x.select("id", "status", F.col("analysis.digital_presence_score").cast("double").alias("digital_presence_score"), F.col("analysis.total_estimated_value_usd").alias("total_value"), "address", "email", "latitude", "longitude", F.unix_seconds("freshness.discovered_at").alias("discovered"))


@query("records_newest", with_tables("raw_records", sql="SELECT id, name FROM raw_records ORDER BY created_at DESC, id LIMIT 100 OFFSET 10"))
def _(spark, d):
    return leads.newest(R.raw_records(spark, d), 100, 10).select("id", "name")


@query("records_unresolved", with_tables("raw_records", "entity_links", sql="SELECT id FROM raw_records WHERE NOT EXISTS (SELECT 1 FROM entity_links l WHERE l.raw_record_id = raw_records.id AND l.entity_id < 5)"))
def _(spark, d):
    return leads.unresolved(R.raw_records(spark, d), R.entity_links(spark, d).filter("entity_id < 5")).select("id")


@query("resolver_view", with_tables("raw_records", sql="SELECT id, name, website, email, array_to_string(CASE WHEN len(phone_e164) > 0 THEN phone_e164 WHEN phone IS NOT NULL THEN [phone] ELSE [] END, '|') AS phones FROM raw_records"))
def _(spark, d):
    return leads.resolver_view(R.raw_records(spark, d)).select("id", "name", "website", "email", F.concat_ws("|", "phones").alias("phones"))


@query("lead_counts", with_tables(*THREE, sql="SELECT (SELECT count(*) FROM raw_records) AS records, (SELECT count(*) FROM raw_records r LEFT JOIN lead_scores s ON s.raw_record_id = r.id WHERE coalesce(s.status, 'discovered') <> 'rejected') AS active, (SELECT count(*) FROM analyses a JOIN lead_scores s ON s.raw_record_id = a.raw_record_id WHERE coalesce(s.status, 'discovered') <> 'rejected') AS analyzed"))
def _(spark, d):
    return leads.counts(R.raw_records(spark, d), R.analyses(spark, d), R.lead_scores(spark, d))


@query("lead_stats", with_tables(*THREE, sql="SELECT (SELECT count(*) FROM raw_records r LEFT JOIN lead_scores s ON s.raw_record_id = r.id WHERE coalesce(s.status, '') <> 'rejected') AS total_leads, (SELECT count(*) FROM analyses) AS analyzed_leads, round((SELECT coalesce(avg(priority_score), 0.0) FROM lead_scores WHERE status <> 'rejected'), 6) AS average_score"))
def _(spark, d):
    return leads.stats(R.raw_records(spark, d), R.analyses(spark, d), R.lead_scores(spark, d)).withColumn("average_score", F.round("average_score", 6))


@query("age_breakdown", with_tables("raw_records", sql="SELECT calculated_age_class, count(*) AS n FROM raw_records GROUP BY 1"))
def _(spark, d):
    return leads.age_breakdown(R.raw_records(spark, d))


@query("tags_distinct", with_tables("lead_scores", sql="SELECT DISTINCT trim(t) AS tag FROM (SELECT unnest(tags) AS t FROM lead_scores) WHERE trim(t) <> ''"))
def _(spark, d):
    return leads.distinct_tags(R.lead_scores(spark, d))


@query("vocabulary", with_tables("raw_records", sql="SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(concat_ws(chr(10), name, industry, wilaya, address, website, email, phone), '\\b[\\w\\-'']+\\b')) AS word FROM raw_records) WHERE length(word) >= 2"))
def _(spark, d):
    return leads.vocabulary(R.raw_records(spark, d))


@query("lineage", with_tables("raw_records", "entity_links", sql="SELECT l.entity_id, l.raw_record_id, r.name, r.website, r.phone, r.source, epoch(l.linked_at)::BIGINT AS linked FROM entity_links l JOIN raw_records r ON r.id = l.raw_record_id WHERE l.entity_id = 3"))
def _(spark, d):
    return leads.lineage(R.entity_links(spark, d), R.raw_records(spark, d), 3).select("entity_id", "raw_record_id", "name", "website", "phone", "source", F.unix_seconds("linked_at").alias("linked"))


@query("export_csv_rows", _sql("SELECT id, name, industry, wilaya, address, website, phone, email, rating, review_count, source, priority_score, status, calculated_age_class AS freshness, epoch(discovered_at)::BIGINT AS discovered FROM lead_view WHERE status <> 'rejected' ORDER BY priority_score DESC, created_at DESC LIMIT 1000"))
def _(spark, d):
    return sinks.csv_rows(view(spark, d)).withColumn("discovered", F.unix_seconds("discovered_at")).drop("discovered_at")


@query("cache_keys", with_tables("raw_records", sql="SELECT substr(sha256('m::' || name), 1, 2) AS shard, sha256('m::' || name) AS key, name AS reply FROM raw_records"))
def _(spark, d):
    return sinks.cache_rows(R.raw_records(spark, d).select(F.lit("m").alias("model"), F.col("name").alias("prompt"), F.col("name").alias("reply")))


@query("search_bm25", _sql("""
, docs AS (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', name, industry, wilaya, address, email)), '[a-z0-9]+')) AS term FROM lead_view),
lens AS (SELECT id, count(*) AS len FROM docs GROUP BY id),
hits AS (SELECT id, 0 AS k, count(*) AS tf FROM docs WHERE term = 'pharmacie' GROUP BY id UNION ALL SELECT id, 1, count(*) FROM docs WHERE starts_with(term, 'mach') GROUP BY id),
df AS (SELECT k, count(*) AS df FROM hits GROUP BY k), c AS (SELECT (SELECT count(*) FROM lead_view) AS docs, (SELECT count(*) FROM docs) AS tokens),
w AS (SELECT h.id, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len * docs / tokens)) AS x
      FROM hits h JOIN df ON h.k = df.k JOIN lens ON lens.id = h.id CROSS JOIN c)
SELECT w.id, round(sum(x), 6) AS score FROM w JOIN lead_view v ON v.id = w.id WHERE v.status <> 'rejected' GROUP BY w.id HAVING count(*) = 2"""))
def _(spark, d):
    v = view(spark, d)
    return search.search(v, "Pharmacie mach*").join(v.filter("status <> 'rejected'").select("id"), "id").select("id", F.round("score", 6).alias("score"))


@query("search_phrase", _sql("SELECT id FROM lead_view WHERE lower(address) LIKE '% rue de nation 7'"))
def _(spark, d):
    return search.search(view(spark, d), '"rue de Nation 7"').select("id")


# --- scores and analyses ---

_PTS = "CASE WHEN phone IS NOT NULL THEN 15.0 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 10.0 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 10.0 ELSE 0 END + CASE WHEN coalesce(len(social_media_handles), 0) > 0 THEN 5.0 ELSE 0 END + CASE WHEN len(phone_e164) > 0 AND phone_ok THEN 10.0 ELSE 0 END + CASE WHEN len(phone_e164) > 0 THEN CASE phone_kind WHEN 'MOBILE' THEN 10.0 ELSE 3.0 END ELSE 0 END + CASE calculated_age_class WHEN 'hour' THEN 20.0 WHEN 'day' THEN 15.0 WHEN 'week' THEN 10.0 WHEN 'month' THEN 5.0 ELSE 2.0 END"
_DP = "CASE WHEN analyzed THEN digital_presence_score / 100.0 * 20.0 ELSE 0.0 END"


@query("score_breakdown", _sql(f"SELECT id, round(least(100.0, {_PTS} + {_DP})::DOUBLE, 6) AS score, round(({_DP})::DOUBLE, 6) AS digital_presence, CASE WHEN len(phone_e164) > 0 AND phone_kind = 'MOBILE' THEN 10.0::DOUBLE END AS mobile FROM lead_view"))
def _(spark, d):
    s = scoring.score(view(spark, d), R.now())
    return s.select(F.col("raw_record_id").alias("id"), F.round("priority_score", 6).alias("score"), F.round(F.col("score_breakdown")["digital_presence"], 6).alias("digital_presence"), F.col("score_breakdown")["mobile_phone"].alias("mobile"))


_TEXT = "lower(concat(name, ' ', coalesce(website, ''), ' ', coalesce(array_to_string(social_media_handles, ' '), ''), ' ', coalesce(email, '')))"
_WORDS = " + ".join(f"CASE WHEN contains({_TEXT}, '{w}') THEN 10 ELSE 0 END" for w in scoring.PRESENCE_WORDS)
_ABSENT = " + ".join(f"CASE WHEN contains({_TEXT}, '{w}') THEN 15 ELSE 0 END" for w in scoring.ABSENCE_WORDS)
_SERVICE = " || ".join("CASE WHEN contains('" + str(s[3]).lower().replace("'", "''") + f"', industry) THEN '{s[0]};' ELSE '' END" for s in scoring.SERVICES)


@query("heuristic_analysis", with_tables("raw_records", sql=f"""
@ p AS (SELECT *, greatest(0, least(100, 30 + {_WORDS} - ({_ABSENT}) + CASE WHEN phone IS NULL THEN 0 ELSE 5 END + CASE WHEN email IS NULL THEN 0 ELSE 5 END + CASE WHEN coalesce(len(social_media_handles), 0) > 0 THEN 10 ELSE 0 END - CASE WHEN website IS NULL THEN 10 ELSE 0 END))::INT AS presence, {_SERVICE} AS fit FROM raw_records)
SELECT id, presence, (presence < 50)::INT + (phone IS NULL)::INT + (email IS NULL)::INT + (website IS NULL)::INT + (coalesce(len(social_media_handles), 0) = 0)::INT AS pains,
       array_to_string(CASE WHEN fit = '' THEN ['Pharmacy Inventory & Refill System', 'Restaurant POS & Online Ordering', 'E-commerce Website'] ELSE list_slice(string_split(rtrim(fit, ';'), ';'), 1, 3) END, ';') AS services FROM p"""))
def _(spark, d):
    a = scoring.analyse(R.raw_records(spark, d), R.now())
    pains = F.size(F.filter("pain_points", lambda p: p != scoring.NO_PAIN))
    return a.select(F.col("raw_record_id").alias("id"), F.col("digital_presence_score").alias("presence"), pains.alias("pains"), F.array_join(F.transform("recommended_solutions", lambda s: s["service_name"]), ";").alias("services"))


@query("analysis_pending", with_tables("raw_records", "analyses", sql="SELECT id FROM raw_records WHERE id NOT IN (SELECT raw_record_id FROM analyses)"))
def _(spark, d):
    return scoring.pending(R.raw_records(spark, d), R.analyses(spark, d)).select("id")


# --- upserts ---


def _again(spark, d) -> DataFrame:
    """A second sighting of every third record, and as many new ones."""
    r = R.raw_records(spark, d).filter("id % 3 = 0")
    seen = r.withColumns({"name": F.lit("changed"), "rating": F.lit(4.5), "last_updated": R.now(), "calculated_age_class": F.lit("hour")})
    return seen.unionByName(seen.withColumns({"fingerprint": F.concat(F.lit("new"), F.col("id").cast("string")), "id": F.col("id") + 10_000_000}))


@query("upsert_raw", with_tables("raw_records", sql=f"""
SELECT id, name, CASE WHEN id % 3 = 0 THEN 4.5 ELSE rating END AS rating, CASE WHEN id % 3 = 0 THEN 'hour' ELSE calculated_age_class END AS age, CASE WHEN id % 3 = 0 THEN {R.NOW} ELSE epoch(last_updated)::BIGINT END AS updated, phone FROM raw_records
UNION ALL SELECT id + 10000000, 'changed', 4.5, 'hour', {R.NOW}, phone FROM raw_records WHERE id % 3 = 0"""))
def _(spark, d):
    return store.save_records(R.raw_records(spark, d), _again(spark, d)).select("id", "name", F.col("rating"), F.col("calculated_age_class").alias("age"), F.unix_seconds("last_updated").alias("updated"), "phone")


@query("upsert_summary", with_tables("raw_records", sql="SELECT (2 * count(*))::BIGINT AS discovered, count(*) AS inserted, count(*) AS updated, 0::BIGINT AS repeated FROM raw_records WHERE id % 3 = 0"))
def _(spark, d):
    return store.save_summary(R.raw_records(spark, d), _again(spark, d))


def _manual(spark, d) -> tuple[DataFrame, DataFrame]:
    r, s = R.raw_records(spark, d), R.lead_scores(spark, d)
    new = r.filter("id % 4 = 0").withColumns({c: F.lit("given") for c in ("address", "website", "phone", "email")}).withColumn("tags", F.array(F.lit("hand")))
    return store.save_manual(r, s, new, R.now())


@query("upsert_manual", with_tables("raw_records", sql="SELECT id, " + ", ".join(f"CASE WHEN id % 4 = 0 THEN coalesce({c}, 'given') ELSE {c} END AS {c}" for c in ("address", "website", "phone", "email")) + " FROM raw_records"))
def _(spark, d):
    return _manual(spark, d)[0].select("id", "address", "website", "phone", "email")


@query("upsert_manual_scores", with_tables("raw_records", "lead_scores", sql="SELECT coalesce(s.raw_record_id, r.id) AS id, CASE WHEN s.raw_record_id IS NULL THEN 'verified' ELSE s.status END AS status, CASE WHEN r.id IS NOT NULL THEN 'hand' ELSE coalesce(array_to_string(s.tags, '|'), '') END AS tags, coalesce(s.priority_score, 0) AS score FROM lead_scores s FULL JOIN (SELECT id FROM raw_records WHERE id % 4 = 0) r ON r.id = s.raw_record_id"))
def _(spark, d):
    return _manual(spark, d)[1].select(F.col("raw_record_id").alias("id"), "status", F.concat_ws("|", "tags").alias("tags"), F.col("priority_score").alias("score"))


@query("upsert_score", with_tables("raw_records", "lead_scores", sql="SELECT coalesce(s.raw_record_id, r.id) AS id, CASE WHEN r.id IS NULL OR s.status IN ('contacted', 'rejected') THEN s.status ELSE 'scored' END AS status, CASE WHEN r.id IS NULL THEN s.priority_score ELSE 42.0 END AS score, coalesce(s.is_contact, false) AS is_contact FROM lead_scores s FULL JOIN (SELECT id FROM raw_records WHERE id % 2 = 0) r ON r.id = s.raw_record_id"))
def _(spark, d):
    new = R.raw_records(spark, d).filter("id % 2 = 0").select(F.col("id").alias("raw_record_id"), F.lit(42.0).alias("priority_score"), F.create_map(F.lit("x"), F.lit(42.0)).alias("score_breakdown"), R.now().alias("computed_at"))
    return store.save_scores(R.lead_scores(spark, d), new).select(F.col("raw_record_id").alias("id"), "status", F.col("priority_score").alias("score"), "is_contact")


@query("upsert_analysis", with_tables("analyses", sql="SELECT raw_record_id AS id, CASE WHEN raw_record_id % 5 = 0 THEN 99 ELSE digital_presence_score END AS presence FROM analyses"))
def _(spark, d):
    a = R.analyses(spark, d)
    new = a.filter("raw_record_id % 5 = 0").withColumn("digital_presence_score", F.lit(99))
    return store.attach_analyses(a, R.lead_scores(spark, d), new, R.now())[0].select(F.col("raw_record_id").alias("id"), F.col("digital_presence_score").alias("presence"))


@query("upsert_analysis_status", with_tables("analyses", "lead_scores", sql="SELECT coalesce(s.raw_record_id, a.raw_record_id) AS id, CASE WHEN a.raw_record_id IS NOT NULL THEN 'analyzed' ELSE s.status END AS status, coalesce(s.priority_score, 0) AS score FROM lead_scores s FULL JOIN (SELECT raw_record_id FROM analyses WHERE raw_record_id % 5 = 0) a ON a.raw_record_id = s.raw_record_id"))
def _(spark, d):
    a = R.analyses(spark, d)
    return store.attach_analyses(a, R.lead_scores(spark, d), a.filter("raw_record_id % 5 = 0"), R.now())[1].select(F.col("raw_record_id").alias("id"), "status", F.col("priority_score").alias("score"))


_SET = "FROM lead_scores s FULL JOIN (SELECT id FROM raw_records WHERE id % 6 = 1) r ON r.id = s.raw_record_id"


@query("bulk_status", with_tables("raw_records", "lead_scores", sql=f"SELECT coalesce(s.raw_record_id, r.id) AS id, CASE WHEN r.id IS NULL THEN s.status ELSE 'contacted' END AS status, CASE WHEN r.id IS NULL THEN epoch(s.computed_at)::BIGINT ELSE {R.NOW} END AS computed {_SET}"))
def _(spark, d):
    ids = R.raw_records(spark, d).filter("id % 6 = 1").select(F.col("id").alias("raw_record_id"))
    return store.set_fields(R.lead_scores(spark, d), ids, R.now(), status="contacted").select(F.col("raw_record_id").alias("id"), "status", F.unix_seconds("computed_at").alias("computed"))


@query("bulk_contact", with_tables("raw_records", "lead_scores", sql=f"SELECT coalesce(s.raw_record_id, r.id) AS id, coalesce(s.status, 'discovered') AS status, CASE WHEN r.id IS NULL THEN s.is_contact ELSE true END AS is_contact {_SET}"))
def _(spark, d):
    ids = R.raw_records(spark, d).filter("id % 6 = 1").select(F.col("id").alias("raw_record_id"))
    return store.set_fields(R.lead_scores(spark, d), ids, R.now(), is_contact=True).select(F.col("raw_record_id").alias("id"), "status", "is_contact")


@query("set_status", with_tables("raw_records", "lead_scores", sql=f"SELECT coalesce(s.raw_record_id, r.id) AS id, CASE WHEN r.id IS NULL THEN s.status ELSE 'rejected' END AS status, epoch(coalesce(s.computed_at, make_timestamp({R.NOW}::BIGINT * 1000000)))::BIGINT AS computed {_SET}"))
def _(spark, d):
    ids = R.raw_records(spark, d).filter("id % 6 = 1").select(F.col("id").alias("raw_record_id"))
    return store.set_fields(R.lead_scores(spark, d), ids, R.now(), status="rejected", touch=False).select(F.col("raw_record_id").alias("id"), "status", F.unix_seconds("computed_at").alias("computed"))


@query("set_tags", with_tables("raw_records", "lead_scores", sql=f"SELECT coalesce(s.raw_record_id, r.id) AS id, CASE WHEN r.id IS NULL THEN array_to_string(s.tags, '|') ELSE 'a|b' END AS tags, coalesce(s.status, 'discovered') AS status {_SET}"))
def _(spark, d):
    ids = R.raw_records(spark, d).filter("id % 6 = 1").select(F.col("id").alias("raw_record_id"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return store.set_tags(R.lead_scores(spark, d), ids, R.now()).select(F.col("raw_record_id").alias("id"), F.concat_ws("|", "tags").alias("tags"), "status")


@query("edit_leads", with_tables("raw_records", sql="SELECT id, CASE WHEN id % 5 = 2 THEN 'edited' ELSE name END AS name, CASE WHEN id % 5 = 2 THEN NULL ELSE phone END AS phone, website FROM raw_records"))
def _(spark, d):
    r = R.raw_records(spark, d)
    edits = r.filter("id % 5 = 2").select("id", F.lit("edited").alias("name"), "address", "website", F.lit(None).cast("string").alias("phone"), "email")
    return store.edit_records(r, edits).select("id", "name", "phone", "website")


@query("save_entities", with_tables("raw_records", "entity_links", sql="SELECT entity_id, raw_record_id FROM entity_links WHERE entity_id <> 2 UNION ALL SELECT 2, id FROM raw_records WHERE id % 50 = 0"))
def _(spark, d):
    from leadweave.schemas import empty

    ids = R.raw_records(spark, d).filter("id % 50 = 0").agg(F.collect_list("id").alias("x")).select(F.concat("x", "x").alias("raw_record_ids"), F.lit(2).cast("long").alias("id"), F.lit("e").alias("name"), F.array(F.lit("+213")).alias("phones"), F.lit(0.9).alias("confidence"))
    return store.save_entities(empty(spark, "resolved_entities"), R.entity_links(spark, d), ids, R.now())[1].select("entity_id", "raw_record_id")


@query("delete_rows", with_tables("raw_records", sql="SELECT id FROM raw_records WHERE id % 2 = 1"))
def _(spark, d):
    r = R.raw_records(spark, d)
    return store.without(r, r.filter("id % 2 = 0")).select("id")


# --- entity resolution over part: names repeat, contacts by key ---


def parts(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    p = R.table(spark, d, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.concat("p_name", F.lit(" "), (k % 1000).cast("string")).alias("name"), F.lit("x").alias("industry"), F.lit("y").alias("wilaya"), none.alias("address"),
        F.when(k % 3 != 0, F.concat(F.lit("http://s"), (k % 400).cast("string"), F.lit(".dz"))).alias("website"), F.when(k % 4 == 1, F.concat(F.lit("+21355"), (k % 500).cast("string"))).alias("phone"),
        F.when(k % 5 == 1, F.concat(F.lit("m"), (k % 300).cast("string"), F.lit("@a.dz"))).alias("email"), F.array().cast("array<string>").alias("social_media_handles"), F.lit(0.0).alias("rating"), F.lit(0).alias("review_count"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.array().cast("array<struct<e164:string>>").alias("phone_metadata"), F.timestamp_seconds(k).alias("created_at"),
    )


_ER = """
WITH RECURSIVE rec AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 1000)::VARCHAR AS name, CASE WHEN p_partkey % 3 <> 0 THEN 's' || (p_partkey % 400)::VARCHAR || '.dz' ELSE '' END AS web,
  CASE WHEN p_partkey % 4 = 1 THEN '+21355' || (p_partkey % 500)::VARCHAR ELSE '' END AS phone, CASE WHEN p_partkey % 5 = 1 THEN 'm' || (p_partkey % 300)::VARCHAR || '@a.dz' ELSE '' END AS email FROM part),
bare AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS b FROM rec),
blocks AS (SELECT DISTINCT id, substr(b, i, 3) AS block FROM (SELECT id, b, unnest(generate_series(1, length(b) - 2)) AS i FROM bare WHERE length(b) >= 3) UNION ALL SELECT id, '__short__' FROM bare WHERE length(b) < 3),
sizes AS (SELECT block, count(*) AS n FROM blocks GROUP BY block),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM blocks x JOIN sizes s ON s.block = x.block AND n BETWEEN 2 AND 100 JOIN blocks y ON y.block = x.block AND x.id < y.id),
scored AS (SELECT a, b, CASE WHEN x.name = y.name THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(lower(x.name), lower(y.name))::DOUBLE / greatest(length(x.name), length(y.name)) END AS nm,
  CASE WHEN x.web <> '' AND y.web <> '' THEN (x.web = y.web)::INT::DOUBLE WHEN x.web = '' AND y.web = '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS wb,
  CASE WHEN x.phone <> '' AND y.phone <> '' THEN (x.phone = y.phone)::INT::DOUBLE WHEN x.phone = '' AND y.phone = '' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS ph,
  CASE WHEN x.email <> '' AND y.email <> '' THEN (x.email = y.email)::INT::DOUBLE WHEN x.email = '' AND y.email = '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS em
  FROM pairs JOIN rec x ON x.id = a JOIN rec y ON y.id = b),
total AS (SELECT *, nm * 0.40::DOUBLE + wb * 0.25::DOUBLE + ph * 0.20::DOUBLE + em * 0.15::DOUBLE AS score FROM scored),
edges AS (SELECT a, b FROM total WHERE score >= 0.65::DOUBLE),
"""
_CC = _ER + """both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach AS (SELECT id AS node, id AS root FROM rec UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.node WHERE r.root < b.b),
cl AS (SELECT node AS id, min(root) AS cluster FROM reach GROUP BY node)
"""


@query("er_blocks", _ER.rstrip().rstrip(",") + " SELECT block, n FROM sizes")
def _(spark, d):
    return resolve.block_sizes(parts(spark, d))


@query("er_pairs", _ER.rstrip().rstrip(",") + " SELECT a, b FROM pairs")
def _(spark, d):
    return resolve.candidate_pairs(parts(spark, d))


@query("er_scores", _ER.rstrip().rstrip(",") + " SELECT a, b, round(nm, 6) AS name_score, wb AS website_score, ph AS phone_score, em AS email_score, round(score, 6) AS score FROM total")
def _(spark, d):
    s = resolve.scored_pairs(parts(spark, d))
    return s.select("a", "b", F.round("name_score", 6).alias("name_score"), "website_score", "phone_score", "email_score", F.round("score", 6).alias("score"))


@query("er_components", _CC + "SELECT id, cluster FROM cl")
def _(spark, d):
    return resolve.clusters(parts(spark, d))


@query("er_golden", _CC + """, m AS (SELECT cluster, r.* FROM cl JOIN rec r ON r.id = cl.id)
SELECT cluster AS id, count(*) AS n, CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE round(least(0.99, 0.7 + 0.1 * count(*)), 6)::DOUBLE END AS confidence, CASE WHEN count(*) = 1 THEN 'single' ELSE 'graph_merge' END AS strategy,
  coalesce(string_agg(DISTINCT phone, '|' ORDER BY phone) FILTER (WHERE phone <> ''), '') AS phones, string_agg(id::VARCHAR, '|' ORDER BY id) AS ids,
  arg_max(name, ((2 + 1 + (web <> '')::INT + (phone <> '')::INT + (email <> '')::INT)::BIGINT * 1000000000 - id)) AS name FROM m GROUP BY cluster""")
def _(spark, d):
    e = resolve.resolve(parts(spark, d))
    return e.select("id", F.size("raw_record_ids").cast("long").alias("n"), F.round("confidence", 6).alias("confidence"), "strategy", F.concat_ws("|", "phones").alias("phones"), F.array_join(F.col("raw_record_ids").cast("array<string>"), "|").alias("ids"), "name")
