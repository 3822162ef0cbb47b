"""Schemas of the stored tables, their defaults, versions and checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that enumerated columns may hold.
SOURCES = ("overpass", "duckduckgo", "searxng", "social", "manual", "mock", "infinite")
STATUSES = ("discovered", "analyzed", "scored", "contacted", "rejected", "verified")
AGES = ("hour", "day", "week", "month", "older")
QUEUE_STATES = ("pending", "processing", "completed", "failed")

_PHONE = "struct<original_string:string,e164:string,international:string,national:string,phone_type:string,region:string,carrier:string,is_valid:boolean>"
_SOLUTION = "struct<service_name:string,justification:string,estimated_value_usd:double,priority:int>"


class _Tables(Mapping):
    """Schemas by name; their DDL is parsed on first use, as that needs a session."""

    def __init__(self, **ddl: str):
        self._ddl, self._parsed = ddl, {}

    def __getitem__(self, name: str) -> T.StructType:
        if name not in self._parsed:
            self._parsed[name] = T.StructType.fromDDL(self._ddl[name])
        return self._parsed[name]

    def __iter__(self):
        return iter(self._ddl)

    def __len__(self) -> int:
        return len(self._ddl)


TABLES = _Tables(
    raw_records=(
        f"id bigint, fingerprint string, name string, industry string, wilaya string, address string, website string, phone string, email string, social_media_handles array<string>, rating double, review_count int, "
        f"latitude double, longitude double, source string, source_url string, phone_metadata array<{_PHONE}>, raw_html_hash string, discovered_at timestamp, last_updated timestamp, relative_age_hint string, calculated_age_class string, created_at timestamp"
    ),
    analyses=f"raw_record_id bigint, pain_points array<string>, recommended_solutions array<{_SOLUTION}>, digital_presence_score int, pitch_angles array<string>, estimated_monthly_revenue_usd double, analysis_model string, from_cache boolean, analyzed_at timestamp",
    lead_scores="raw_record_id bigint, priority_score double, score_breakdown map<string,double>, status string, tags array<string>, computed_at timestamp, is_contact boolean",
    resolved_entities=(
        "id bigint, entity_type string, name string, industry string, wilaya string, address string, website string, phone string, email string, social_media_handles array<string>, phones array<string>, rating double, review_count int, "
        "latitude double, longitude double, confidence double, strategy string, raw_record_ids array<bigint>, last_resolved_at timestamp"
    ),
    entity_links="id bigint, entity_id bigint, raw_record_id bigint, match_score double, match_reasons array<string>, linked_at timestamp",
    crawl_queue="id bigint, url string, domain string, priority int, depth int, status string, last_attempted timestamp, fail_count int, created_at timestamp",
    domain_politeness="domain string, last_visited_at timestamp",
    discovery_campaigns="id bigint, query string, wilaya string, limit_num int, status string, discovered_qty int, saved_qty int, created_at timestamp, updated_at timestamp",
    lead_attachments="id bigint, raw_record_id bigint, filename string, mime_type string, file_path string, created_at timestamp",
    schema_migrations="version int, description string, applied_at timestamp",
)

#: Column defaults that a stored null stands for.
DEFAULTS = {
    "raw_records": {"rating": 0.0, "review_count": 0, "calculated_age_class": "older"},
    "analyses": {"digital_presence_score": 50, "from_cache": False},
    "lead_scores": {"priority_score": 0.0, "status": "discovered", "is_contact": False},
    "resolved_entities": {"confidence": 1.0},
    "crawl_queue": {"priority": 1, "depth": 0, "status": "pending", "fail_count": 0},
}

#: What a row must satisfy, as SQL.
CHECKS = {
    "raw_records": {"name": "length(trim(name)) >= 1", "rating": "rating BETWEEN 0 AND 5", "review_count": "review_count >= 0", "latitude": "latitude IS NULL OR latitude BETWEEN -90 AND 90", "longitude": "longitude IS NULL OR longitude BETWEEN -180 AND 180", "age": f"calculated_age_class IN {AGES}"},
    "analyses": {"digital_presence_score": "digital_presence_score BETWEEN 0 AND 100"},
    "lead_scores": {"priority_score": "priority_score BETWEEN 0 AND 100", "status": f"status IN {STATUSES}"},
    "resolved_entities": {"confidence": "confidence BETWEEN 0 AND 1"},
    "crawl_queue": {"status": f"status IN {QUEUE_STATES}", "domain": "domain = lower(domain) AND domain NOT LIKE '.%'"},
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def with_defaults(df: DataFrame, name: str) -> DataFrame:
    return df.fillna(DEFAULTS.get(name, {}))


def split_valid(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks of a table, and the others with ``faults``, the names of the checks they fail."""
    checks = CHECKS.get(name, {})
    faults = F.filter(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("faults", faults if checks else F.array().cast("array<string>"))
    return marked.filter(F.size("faults") == 0).drop("faults"), marked.filter(F.size("faults") > 0)


class Migrations:
    """Numbered changes of tables, applied in order on read."""

    def __init__(self):
        self.steps: dict[int, tuple[str, str, Callable[[DataFrame], DataFrame]]] = {}

    def step(self, version: int, table: str, description: str):
        """Decorator that registers a change DataFrame -> DataFrame of one table."""

        def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            if version in self.steps:
                raise ValueError(f"version {version} exists")
            self.steps[version] = (table, description, f)
            return f

        return add

    def upgrade(self, df: DataFrame, table: str, since: int = 0) -> DataFrame:
        todo = [f for v, (t, _, f) in sorted(self.steps.items()) if v > since and t == table]
        return reduce(lambda d, f: f(d), todo, df)

    def log(self, spark: SparkSession) -> DataFrame:
        """schema_migrations without times: version and description of every registered change."""
        return spark.createDataFrame([(v, d) for v, (_, d, _) in sorted(self.steps.items())], "version int, description string")


MIGRATIONS = Migrations()


def _missing(name: str, column: str, value) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df if column in df.columns else df.withColumn(column, F.lit(value).cast(TABLES[name][column].dataType))


MIGRATIONS.step(1, "raw_records", "age class and hint of a record")(lambda df: _missing("raw_records", "calculated_age_class", "older")(_missing("raw_records", "relative_age_hint", None)(df)))
MIGRATIONS.step(2, "resolved_entities", "confidence of an entity")(_missing("resolved_entities", "confidence", 1.0))
MIGRATIONS.step(3, "lead_scores", "contact flag of a lead")(_missing("lead_scores", "is_contact", False))


def current_version(applied: DataFrame) -> DataFrame:
    """One row: the largest applied version, 0 for none."""
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
