"""Lead scores and the rule-based needs analysis, as columns over the lead view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.text import cache_key, or_empty
from leadweave.functions.values import SOLUTIONS, analysis_of, clamp, tolerant_json
from leadweave.sources.catalogues import SERVICES

# Points of the score.
POINTS = {"has_phone": 15.0, "has_email": 10.0, "has_website": 10.0, "has_social": 5.0, "verified_phone": 10.0, "mobile_phone": 10.0, "landline_phone": 3.0}
FRESHNESS_POINTS = {"hour": 20.0, "day": 15.0, "week": 10.0, "month": 5.0, "older": 2.0}
# Words that raise and lower the estimate of digital presence.
PRESENCE_WORDS = ("website", "www", "http", "facebook", "instagram", "linkedin", "menu", "online order", "réservation", "booking")
ABSENCE_WORDS = ("no website", "pas de site", "site web en construction")
# Pain points in their order, and what is said where there is none.
PAINS = (
    "Weak online presence — customers struggle to find the business online.",
    "No public phone number — leads cannot easily reach out.",
    "No public email — outbound sales outreach will be harder.",
    "No website — competitor with a website will capture online demand.",
    "No social media presence — limited discoverability by younger demographics.",
)
NO_PAIN = "No obvious pain points detected — likely already digitally mature."
MODEL = "heuristic-fallback"


def _has(c: str) -> Column:
    return or_empty(F.col(c)) != ""


def _has_social() -> Column:
    return F.coalesce(F.size("social_media_handles"), F.lit(0)) > 0


def breakdown() -> Column:
    """map<string,double>: the factors that apply, with their points. Only the first validated phone counts."""
    first = F.get("phone_metadata", F.lit(0))
    given = {
        "has_phone": _has("phone"), "has_email": _has("email"), "has_website": _has("website"), "has_social": _has_social(), "verified_phone": F.coalesce(first["is_valid"], F.lit(False)),
        "mobile_phone": F.coalesce(first["phone_type"] == "MOBILE", F.lit(False)), "landline_phone": F.coalesce(first["phone_type"] == "LANDLINE", F.lit(False)),
    }
    fresh = reduce(lambda w, kv: w.when(F.col("calculated_age_class") == kv[0], kv[1]), FRESHNESS_POINTS.items(), F.when(F.lit(False), 0.0)).otherwise(2.0)
    presence = F.when(F.col("analyzed"), F.col("digital_presence_score") / 100.0 * 20.0).otherwise(0.0)
    every = F.create_map(*[x for k, c in given.items() for x in (F.lit(k), F.when(c, POINTS[k]))], F.lit("freshness"), fresh, F.lit("digital_presence"), presence)
    return F.map_filter(every, lambda _, v: v.isNotNull())


def total(points: Column) -> Column:
    """Sum of a breakdown, 100 at most."""
    return F.least(F.lit(100.0), F.aggregate(F.map_values(points), F.lit(0.0), lambda a, x: a + x))


def score(view: DataFrame, now: Column, points: Column | None = None) -> DataFrame:
    """Score rows of the leads of a view; another breakdown may be given."""
    return view.withColumn("score_breakdown", breakdown() if points is None else points).select(F.col("id").alias("raw_record_id"), total(F.col("score_breakdown")).alias("priority_score"), "score_breakdown", now.alias("computed_at"))


def services_for(industry: Column) -> Column:
    """array<struct<name, value, priority, pitch>>: the services for an industry in catalogue order, else the three of
    highest priority. An industry fits where it occurs anywhere in a service's list, so an empty one fits all."""
    key = F.lower(F.trim(or_empty(industry)))
    made = lambda s: F.struct(F.lit(s[0]).alias("name"), F.lit(s[1]).alias("value"), F.lit(s[2]).alias("priority"), F.lit(s[4]).alias("pitch"))
    fits = F.filter(F.array(*[F.when(F.lit(str(s[3]).lower()).contains(key), made(s)) for s in SERVICES]), lambda x: x.isNotNull())
    top = F.array(*[made(s) for s in sorted(SERVICES, key=lambda s: -s[2])[:3]])
    return F.when(F.size(fits) > 0, fits).otherwise(top)


def digital_presence() -> Column:
    """30, plus 10 for each telling word and less 15 for each that denies a site, with points for channels; 0 to 100."""
    text = F.lower(F.concat_ws(" ", or_empty(F.col("name")), or_empty(F.col("website")), F.array_join(F.coalesce("social_media_handles", F.array().cast("array<string>")), " "), or_empty(F.col("email"))))
    count = lambda ws: sum((text.contains(w).cast("int") for w in ws), F.lit(0))
    s = F.lit(30) + 10 * count(PRESENCE_WORDS) - 15 * count(ABSENCE_WORDS)
    s = s + F.when(_has("phone"), 5).otherwise(0) + F.when(_has("email"), 5).otherwise(0) + F.when(_has_social(), 10).otherwise(0) - F.when(_has("website"), 0).otherwise(10)
    return clamp(s, 0, 100).cast("int")


def pain_points(presence: Column) -> Column:
    found = F.array(*[F.when(c, F.lit(t)) for c, t in zip((presence < 50, ~_has("phone"), ~_has("email"), ~_has("website"), ~_has_social()), PAINS)])
    found = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_PAIN)))


def analyse(records: DataFrame, now: Column) -> DataFrame:
    """Analysis rows of records by rule: three services at most, two pitches."""
    rows = records.withColumn("__fit", services_for(F.col("industry"))).withColumn("__presence", digital_presence())
    why = F.concat(F.lit("Heuristic match for industry '"), or_empty(F.col("industry")), F.lit("'."))
    solutions = F.transform(F.slice("__fit", 1, 3), lambda s: F.struct(s["name"].alias("service_name"), why.alias("justification"), s["value"].alias("estimated_value_usd"), s["priority"].alias("priority")))
    return rows.select(
        F.col("id").alias("raw_record_id"), pain_points(F.col("__presence")).alias("pain_points"), solutions.alias("recommended_solutions"), F.col("__presence").alias("digital_presence_score"),
        F.transform(F.slice("__fit", 1, 2), lambda s: s["pitch"]).alias("pitch_angles"), F.lit(None).cast("double").alias("estimated_monthly_revenue_usd"), F.lit(MODEL).alias("analysis_model"), F.lit(False).alias("from_cache"), now.alias("analyzed_at"),
    )


def pending(records: DataFrame, analyses: DataFrame, again: bool = False) -> DataFrame:
    """Records to analyse: those without an analysis, or all of them ``again``."""
    return records if again else records.join(analyses.select(F.col("raw_record_id").alias("id")), "id", "left_anti")


def with_cached_replies(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts (id, model, prompt) with the cached reply, null where there is none. The cache is partitioned by the key's shard."""
    keyed = prompts.withColumn("key", cache_key(F.col("model"), F.col("prompt"))).withColumn("shard", F.substring("key", 1, 2))
    return keyed.join(cache.select("shard", "key", "reply"), ["shard", "key"], "left")


#: What a model is told of a record.
PROMPT_FIELDS = ("name", "industry", "wilaya", "address", "website", "phone", "email", "social_media_handles", "rating", "review_count")
ASK = (
    "Say what this business needs. Answer with one JSON object that has the keys pain_points and pitch_angles (lists of texts), recommended_solutions "
    "(a list of objects with service_name, justification, estimated_value_usd and priority from 1 to 10), digital_presence_score (0 to 100) and "
    "estimated_monthly_revenue_usd (a number or null).\n"
)


def prompts(records: DataFrame, fields: Sequence[str] = PROMPT_FIELDS) -> DataFrame:
    """(id, prompt): the question about each record."""
    return records.select("id", F.concat(F.lit(ASK), F.to_json(F.struct(*fields))).alias("prompt"))


def replies(asked: DataFrame, models: Sequence[str], cache: DataFrame) -> DataFrame:
    """Prompts (id, prompt) with a cached reply: (id, model, reply, batch) of the first model in order that has one."""
    every = asked.select("id", F.posexplode(F.array(*map(F.lit, models))).alias("rank", "model"), "prompt")
    held = with_cached_replies(every, cache.select("shard", "key", F.struct("reply", "batch").alias("reply"))).filter("reply IS NOT NULL")
    first = held.groupBy("id").agg(F.min(F.struct("rank", "model", "reply")).alias("x"))
    return first.select("id", "x.model", "x.reply.reply", "x.reply.batch")


def analyse_by_models(records: DataFrame, answers: DataFrame, batch: str, now: Column) -> DataFrame:
    """Analysis rows of records from replies (id, model, reply, batch); by rule where there is none, or none that is an object
    with a presence of 0 to 100. Replies of another batch than this one are from the cache."""
    parsed = answers.withColumn("__v", tolerant_json(F.col("reply"))).withColumn("__a", analysis_of(F.col("__v")))
    parsed = parsed.filter(F.schema_of_variant("__v").startswith("OBJECT") & F.col("__a.digital_presence_score").between(0, 100))
    parsed = parsed.select(F.col("id").alias("raw_record_id"), "__a", F.col("model").alias("__model"), (F.col("batch") != batch).alias("__held"))
    made = analyse(records, now).withColumn("recommended_solutions", F.col("recommended_solutions").cast(SOLUTIONS)).join(parsed, "raw_record_id", "left")
    by_model = {f: F.col(f"__a.{f}") for f in ("pain_points", "recommended_solutions", "digital_presence_score", "pitch_angles", "estimated_monthly_revenue_usd")} | {"analysis_model": F.col("__model"), "from_cache": F.col("__held")}
    return made.select("raw_record_id", *[F.when(F.col("__model").isNotNull(), c).otherwise(F.col(f)).alias(f) for f, c in by_model.items()], "analyzed_at")
