"""Column functions over numbers, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave.functions.text import or_empty

SOLUTIONS = "array<struct<service_name:string,justification:string,estimated_value_usd:double,priority:int>>"


def clamp(c: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def merge_confidence(n: Column) -> Column:
    """1 for a single record, else 0.7 + 0.1 for each record, 0.99 at most."""
    return F.when(n <= 1, 1.0).otherwise(F.least(F.lit(0.99), F.lit(0.7) + F.lit(0.1) * n))


def jittered(seconds: Column, share: float, unit: Column | None = None) -> Column:
    """Seconds moved by up to ``share`` of them to either side; ``unit`` is uniform in 0 to 1 (drawn if none is given)."""
    return seconds * (1 + F.lit(share) * (2 * (F.rand() if unit is None else unit) - 1))


def backoff(attempt: Column, base: float = 2.0, most: float = 60.0, factor: float = 2.0, jitter: float = 0.0, unit: Column | None = None) -> Column:
    """Seconds before a retry: base times factor to the attempt, bounded, with jitter, 0.1 at least."""
    wait = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(factor), attempt))
    return F.greatest(F.lit(0.1), jittered(wait, jitter, unit) if jitter else wait)


def proxy_health(outcomes: Column) -> Column:
    """Fold ordered outcomes (array of booleans) to struct<health, fails, state>.

    A success adds 5 up to 100 and ends a run of failures; a failure takes 15 times the length of the run, 0 at least.
    From 80 HEALTHY, from 30 DEGRADED, below UNHEALTHY; a failure never leaves HEALTHY. No outcomes: HEALTHY at 100."""
    start = F.struct(F.lit(100.0).alias("health"), F.lit(0).alias("fails"), F.lit("HEALTHY").alias("state"))

    def step(s: Column, ok: Column) -> Column:
        fails = F.when(ok, F.lit(0)).otherwise(s["fails"] + 1)
        health = F.when(ok, F.least(F.lit(100.0), s["health"] + 5.0)).otherwise(F.greatest(F.lit(0.0), s["health"] - 15.0 * fails))
        state = F.when(health < 30, F.when(ok, s["state"]).otherwise("UNHEALTHY")).when(ok & (health >= 80), "HEALTHY").otherwise("DEGRADED")
        return F.struct(health.alias("health"), fails.alias("fails"), state.alias("state"))

    return F.aggregate(outcomes, start, step)


def list_setting(text: Column) -> Column:
    """A comma-separated setting as an array without blanks."""
    return F.filter(F.transform(F.split(or_empty(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def string_list(json: Column) -> Column:
    """A JSON array as strings; anything else: empty."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def joined_parts(*parts: Column) -> Column:
    """Non-empty parts with commas between; none: null."""
    made = F.concat_ws(", ", *[F.when(p != "", p) for p in parts])
    return F.when(made != "", made)


def total_value(solutions: Column) -> Column:
    return F.round(F.aggregate(solutions, F.lit(0.0), lambda a, s: a + F.coalesce(s["estimated_value_usd"], F.lit(0.0))), 2)


def tolerant_json(reply: Column) -> Column:
    """Variant of a model's reply: without a code fence, else its outermost object, else its outermost list; null if none parses."""
    t = F.trim(or_empty(reply))
    fenced = F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"```$", ""))
    t = F.when(t.startswith("```"), fenced).otherwise(t)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)), F.try_parse_json(F.regexp_extract(t, r"(?s)\[.*\]", 0)))


def analysis_of(payload: Column) -> Column:
    """struct of an analysis from a reply's variant; solutions without a name, or with values out of range, are skipped."""
    get = lambda path, kind: F.try_variant_get(payload, path, kind)
    none = F.array().cast("array<string>")
    solutions = F.coalesce(get("$.recommended_solutions", "array<struct<service_name:string,justification:string,estimated_value_usd:double,priority:int>>"), F.array().cast(SOLUTIONS))
    good = F.filter(solutions, lambda s: s["service_name"].isNotNull() & (F.coalesce(s["estimated_value_usd"], F.lit(0.0)) >= 0) & F.coalesce(s["priority"], F.lit(5)).between(1, 10))
    return F.struct(
        F.coalesce(get("$.pain_points", "array<string>"), none).alias("pain_points"),
        good.alias("recommended_solutions"),
        F.coalesce(get("$.digital_presence_score", "int"), F.lit(50)).alias("digital_presence_score"),
        F.coalesce(get("$.pitch_angles", "array<string>"), none).alias("pitch_angles"),
        get("$.estimated_monthly_revenue_usd", "double").alias("estimated_monthly_revenue_usd"),
    )
