"""The stored relations over the driver's tables, once as DataFrames and once as SQL, by the same expressions.

Expressions are written in the SQL that both engines share; ``ARR(..)`` is an array and ``TS(seconds)`` a time after EPOCH.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200
#: The present of every query.
NOW = EPOCH + 40_000_000


def _calls(e: str, name: str, render: Callable[[str], str]) -> str:
    """Replace every ``name(..)`` of an expression by what ``render`` makes of its arguments."""
    while (at := e.find(f"{name}(")) >= 0:
        start = at + len(name) + 1
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(e[end], 0)
            end += 1
        e = e[:at] + render(e[start : end - 1]) + e[end:]
    return e


def _spark(e: str) -> str:
    return _calls(_calls(e, "ARR", lambda x: f"array({x})"), "TS", lambda x: f"timestamp_seconds({EPOCH} + ({x}))")


def _duck(e: str) -> str:
    return _calls(_calls(e, "ARR", lambda x: f"[{x}]"), "TS", lambda x: f"make_timestamp(({EPOCH} + ({x}))::BIGINT * 1000000)")


RAW = {
    "id": "c_custkey",
    "name": "concat(CASE c_custkey % 4 WHEN 0 THEN 'Pharmacie ' WHEN 1 THEN 'Restaurant ' WHEN 2 THEN 'Atelier ' ELSE 'Clinique ' END, 'Nation ', cast(c_nationkey AS string), ' ', cast(c_custkey % 211 AS string))",
    "industry": "lower(c_mktsegment)",
    "wilaya": "concat('Nation ', cast(c_nationkey AS string))",
    "address": "CASE WHEN c_custkey % 3 <> 0 THEN concat(cast(c_custkey % 50 AS string), ' rue de Nation ', cast(c_nationkey AS string)) END",
    "website": "CASE WHEN c_custkey % 2 = 0 THEN concat('https://www.site', cast(c_custkey % 97 AS string), '.dz/') END",
    "phone": "CASE WHEN c_custkey % 5 <> 0 THEN concat('+2135', lpad(cast(c_custkey % 4000 AS string), 8, '0')) END",
    "email": "CASE WHEN c_custkey % 4 <> 0 THEN concat('info', cast(c_custkey % 89 AS string), '@mail', cast(c_custkey % 7 AS string), '.dz') END",
    "social_media_handles": "CASE WHEN c_custkey % 3 = 0 THEN ARR(concat('https://facebook.com/p', cast(c_custkey % 31 AS string)), 'https://instagram.com/x') WHEN c_custkey % 3 = 1 THEN ARR('https://x.com/y') END",
    "rating": "cast((c_custkey % 50) AS double) / 10",
    "review_count": "cast(c_custkey % 200 AS int)",
    "latitude": "cast(c_custkey % 90 AS double)",
    "longitude": "cast(c_custkey % 180 AS double)",
    "source": "CASE c_custkey % 4 WHEN 0 THEN 'duckduckgo' WHEN 1 THEN 'overpass' WHEN 2 THEN 'manual' ELSE 'mock' END",
    "calculated_age_class": "CASE c_custkey % 5 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'week' WHEN 3 THEN 'month' ELSE 'older' END",
    "phone_e164": "CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 2 THEN ARR(concat('+2135', lpad(cast(c_custkey % 4000 AS string), 8, '0')), concat('+2132', lpad(cast(c_custkey % 71 AS string), 7, '0'))) ELSE ARR() END",
    "phone_kind": "CASE WHEN c_custkey % 2 = 0 THEN 'MOBILE' ELSE 'LANDLINE' END",
    "phone_ok": "c_custkey % 7 <> 0",
    "discovered_at": "TS(c_custkey * 60)",
    "last_updated": "TS(c_custkey * 61)",
    "created_at": "TS(c_custkey * 60)",
}
SCORES = {
    "raw_record_id": "o_custkey",
    "priority_score": "cast((o_custkey * 7 + n) % 101 AS double)",
    "status": "CASE n % 6 WHEN 0 THEN 'discovered' WHEN 1 THEN 'verified' WHEN 2 THEN 'analyzed' WHEN 3 THEN 'scored' WHEN 4 THEN 'contacted' ELSE 'rejected' END",
    "tags": "CASE n % 4 WHEN 0 THEN ARR('vip', ' Oran ') WHEN 1 THEN ARR('Cold') WHEN 2 THEN ARR('VIP', '', 'north') ELSE ARR() END",
    "is_contact": "o_custkey % 5 = 0",
    "computed_at": "TS(o_custkey * 70)",
}
ANALYSES = {
    "raw_record_id": "c_custkey",
    "digital_presence_score": "cast(c_custkey % 101 AS int)",
    "pain_points": "ARR('slow site', concat('gap ', cast(c_custkey % 9 AS string)))",
    "solution_values": "CASE WHEN c_custkey % 3 = 0 THEN ARR(1800.25, 900.5) WHEN c_custkey % 3 = 1 THEN ARR(2500.125) ELSE ARR() END",
    "pitch_angles": "ARR('call first')",
    "analyzed_at": "TS(c_custkey * 80)",
}
QUEUE = {
    "id": "page_id",
    "url": "url",
    "domain": "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))",
    "priority": "cast(page_id % 10 AS int)",
    "depth": "cast(page_id % 4 AS int)",
    "status": "CASE page_id % 5 WHEN 0 THEN 'processing' WHEN 4 THEN 'completed' ELSE 'pending' END",
    "fail_count": "cast(page_id % 6 AS int)",
    "last_attempted": "CASE WHEN page_id % 5 = 0 THEN TS(40000000 - page_id * 7) END",
    "created_at": "TS(page_id * 13 % 1009)",
}


def _select(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{_spark(e)} AS {k}" for k, e in exprs.items()])


def _cte(name: str, exprs: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(f'{_duck(e)} AS {k}' for k, e in exprs.items())} FROM {source})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.timestamp_seconds(F.lit(NOW))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    r = _select(rows, RAW)
    none = F.lit(None).cast("string")
    meta = F.transform("phone_e164", lambda p: F.struct(p.alias("original_string"), p.alias("e164"), p.alias("international"), p.alias("national"), F.col("phone_kind").alias("phone_type"), none.alias("region"), none.alias("carrier"), F.col("phone_ok").alias("is_valid")))
    return r.withColumns({"phone_metadata": meta, "source_url": F.col("website"), "relative_age_hint": none, "fingerprint": F.concat(F.lit("f"), F.col("id").cast("string"))}).drop("phone_e164", "phone_kind", "phone_ok")


def lead_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return _select(orders, SCORES).withColumn("tags", F.col("tags").cast("array<string>")).withColumn("score_breakdown", F.create_map().cast("map<string,double>"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _select(table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 1").select("c_custkey"), ANALYSES)
    made = F.transform(F.col("solution_values").cast("array<double>"), lambda v: F.struct(F.lit("service").alias("service_name"), F.lit("").alias("justification"), v.alias("estimated_value_usd"), F.lit(5).alias("priority")))
    return a.withColumn("recommended_solutions", made).drop("solution_values").withColumns({"estimated_monthly_revenue_usd": F.lit(None).cast("double"), "analysis_model": F.lit("m"), "from_cache": F.lit(False)})


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "pages").select("page_id", "url"), QUEUE).select("id", "url", "domain", "priority", "depth", "status", "last_attempted", "fail_count", "created_at")


def politeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with an even number of pages were visited, at a time that their count gives."""
    q = crawl_queue(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n")).filter("n % 2 = 0")
    return q.select("domain", F.timestamp_seconds(F.lit(NOW) - F.col("n") * 2).alias("last_visited_at"))


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one name prefix and region are one entity."""
    r = raw_records(spark, sf_dir).select("id", "wilaya")
    return r.select(F.col("id"), (F.col("id") % 7).alias("entity_id"), F.col("id").alias("raw_record_id"), F.lit(0.9).alias("match_score"), F.array().cast("array<string>").alias("match_reasons"), F.timestamp_seconds(F.lit(EPOCH) + F.col("id") % 997).alias("linked_at"))


CTE = {
    "raw_records": _cte("raw_records", RAW, "customer JOIN nation ON c_nationkey = n_nationkey"),
    "lead_scores": _cte("lead_scores", SCORES, "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)"),
    "analyses": _cte("analyses", ANALYSES, "(SELECT * FROM customer WHERE c_custkey % 4 <> 1)"),
    "crawl_queue": _cte("crawl_queue", QUEUE, "pages"),
    "politeness": f"politeness AS (SELECT domain, make_timestamp(({NOW} - count(*) * 2)::BIGINT * 1000000) AS last_visited_at FROM crawl_queue GROUP BY domain HAVING count(*) % 2 = 0)",
    "entity_links": f"entity_links AS (SELECT id, id % 7 AS entity_id, id AS raw_record_id, make_timestamp(({EPOCH} + id % 997)::BIGINT * 1000000) AS linked_at FROM raw_records)",
}
_NEEDS = {"politeness": ("crawl_queue",), "entity_links": ("raw_records",)}


def with_tables(*names: str, sql: str, recursive: bool = False) -> str:
    """SQL over relations: their definitions before the query."""
    order: list[str] = []
    for n in names:
        for m in (*_NEEDS.get(n, ()), n):
            if m not in order:
                order.append(m)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(CTE[n] for n in order)}{',' if sql.lstrip().startswith('@') else ''} {sql.lstrip().lstrip('@')}"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values_sql(name: str, rows: list[tuple], columns: list[str]) -> str:
    """The same rows as a table of SQL."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return str(x)

    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"
