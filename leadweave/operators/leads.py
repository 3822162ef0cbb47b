"""The lead read model: joined view, filters, sorting and paging, projections, counts, statistics, vocabulary, lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.text import words
from leadweave.functions.values import total_value
from leadweave.schemas import STATUSES

#: Columns that a list may be sorted by; anything else sorts by score.
SORTS = {"name": "name", "industry": "industry", "wilaya": "wilaya", "phone": "phone", "source": "source", "freshness": "calculated_age_class", "status": "status", "tags": "tags"}


def lead_view(records: DataFrame, analyses: DataFrame, scores: DataFrame) -> DataFrame:
    """Records with their analysis and score, one row each; missing ones leave nulls but for the defaults of a new lead.

    Both right sides have one row a record, so the joins need no aggregate and Spark may broadcast or merge as sizes say."""
    a = analyses.withColumn("analyzed", F.lit(True))
    return (
        records.join(a, records["id"] == a["raw_record_id"], "left")
        .drop("raw_record_id")
        .join(scores.withColumnRenamed("raw_record_id", "scored_id"), F.col("id") == F.col("scored_id"), "left")
        .drop("scored_id")
        .withColumns(
            {
                "analyzed": F.coalesce("analyzed", F.lit(False)),
                "priority_score": F.coalesce("priority_score", F.lit(0.0)),
                "status": F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("discovered"),
                "is_contact": F.coalesce("is_contact", F.lit(False)),
                "rating": F.coalesce("rating", F.lit(0.0)),
                "review_count": F.coalesce("review_count", F.lit(0)),
                # a stored 0 stands for "not given", as a null does
                "digital_presence_score": F.when(F.col("analyzed"), F.coalesce(F.nullif("digital_presence_score", F.lit(0)), F.lit(50))),
            }
        )
    )


@dataclass(frozen=True)
class LeadFilter:
    wilaya: str | None = None
    industry: str | None = None
    age_class: str | None = None
    min_score: float = 0.0
    is_contact: bool | None = None
    tag: str | None = None

    def condition(self) -> Column:
        """Rejected leads never show; ``%`` and ``_`` in an industry are wildcards."""
        c = (F.col("priority_score") >= self.min_score) & (F.col("status") != "rejected")
        if self.wilaya:
            c &= F.lower("wilaya") == self.wilaya.lower()
        if self.industry:
            c &= F.lower("industry").like(f"%{self.industry.lower()}%")
        if self.age_class:
            c &= F.col("calculated_age_class") == self.age_class
        if self.is_contact is not None:
            c &= F.col("is_contact") == self.is_contact
        if self.tag:
            c &= F.coalesce(F.exists("tags", lambda t: F.lower(t) == self.tag.lower()), F.lit(False))
        return c


def sort_order(sort_by: str | None, sort_order: str = "desc") -> list[Column]:
    """Only ``desc`` is descending; newer records first among equals. Nulls are smallest."""
    key = F.col(SORTS.get(sort_by or "", "priority_score"))
    return [key.desc_nulls_last() if sort_order.lower() == "desc" else key.asc_nulls_first(), F.col("created_at").desc_nulls_last()]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order: a top-k of every task, then of those."""
    return df.orderBy(*order).offset(offset).limit(limit)


def list_leads(view: DataFrame, where: LeadFilter = LeadFilter(), sort_by: str | None = None, order: str = "desc", limit: int = 100, offset: int = 0) -> DataFrame:
    return page(view.filter(where.condition()), sort_order(sort_by, order), limit, offset)


def summary(view: DataFrame) -> DataFrame:
    return view.select("id", "name", "industry", "wilaya", "website", "phone", (F.coalesce(F.size("social_media_handles"), F.lit(0)) > 0).alias("has_social"), "rating", "review_count", "source", "priority_score", "status", "tags", "is_contact", F.col("calculated_age_class").alias("freshness"), "digital_presence_score", "discovered_at")


def detail(view: DataFrame) -> DataFrame:
    analysis = F.when(F.col("analyzed"), F.struct("pain_points", "recommended_solutions", "digital_presence_score", "pitch_angles", "estimated_monthly_revenue_usd", "analysis_model", "from_cache", "analyzed_at", total_value(F.col("recommended_solutions")).alias("total_estimated_value_usd")))
    fresh = F.struct("discovered_at", "last_updated", "relative_age_hint", "calculated_age_class")
    return view.select("id", "name", "industry", "wilaya", "website", "phone", "address", "email", F.col("social_media_handles").alias("social_media"), "rating", "review_count", "source", "source_url", "latitude", "longitude", "phone_metadata", fresh.alias("freshness"), "priority_score", "score_breakdown", "status", "tags", "is_contact", analysis.alias("analysis"))


def resolver_view(records: DataFrame) -> DataFrame:
    """What the resolver compares: phones are the validated ones, else the plain one."""
    meta = F.coalesce(F.transform("phone_metadata", lambda p: p["e164"]), F.array().cast("array<string>"))
    phones = F.when(F.size(meta) > 0, meta).when(F.coalesce(F.col("phone"), F.lit("")) != "", F.array("phone")).otherwise(F.array().cast("array<string>"))
    return records.select("id", "name", "website", F.array_distinct(phones).alias("phones"), "email", "address", "wilaya", "industry")


def counts(records: DataFrame, analyses: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: active leads, analysed ones among those with a score row, all records."""
    status = scores.select(F.col("raw_record_id").alias("id"), F.coalesce("status", F.lit("discovered")).alias("status"))
    active = records.select("id").join(status, "id", "left").agg(F.count("*").alias("records"), F.count(F.when(F.coalesce("status", F.lit("discovered")) != "rejected", 1)).alias("active"))
    analysed = analyses.select(F.col("raw_record_id").alias("id")).join(status.filter("status <> 'rejected'"), "id").agg(F.count("*").alias("analyzed"))
    return active.crossJoin(F.broadcast(analysed))  # one row each


def stats(records: DataFrame, analyses: DataFrame, scores: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One row: total_leads (not rejected), analyzed_leads (all analyses), average_score (of score rows not rejected), total_entities."""
    status = scores.select(F.col("raw_record_id").alias("id"), "status", "priority_score")
    total = records.select("id").join(status, "id", "left").agg(F.count(F.when(F.coalesce("status", F.lit("")) != "rejected", 1)).alias("total_leads"))
    out = total.crossJoin(analyses.agg(F.count("*").alias("analyzed_leads"))).crossJoin(scores.filter("status <> 'rejected'").agg(F.coalesce(F.avg("priority_score"), F.lit(0.0)).alias("average_score")))
    return out if entities is None else out.crossJoin(entities.agg(F.count("*").alias("total_entities")))


def age_breakdown(records: DataFrame) -> DataFrame:
    return records.groupBy("calculated_age_class").agg(F.count("*").alias("n"))


def distinct_tags(scores: DataFrame) -> DataFrame:
    return scores.select(F.explode("tags").alias("tag")).select(F.trim("tag").alias("tag")).filter("tag <> ''").distinct().orderBy("tag")


def vocabulary(records: DataFrame) -> DataFrame:
    return records.select(F.explode(words(*[F.col(c) for c in ("name", "industry", "wilaya", "address", "website", "email", "phone")])).alias("word")).distinct().orderBy("word")


def lineage(links: DataFrame, records: DataFrame, entity_id: int | None = None) -> DataFrame:
    """Links with the records that they lead to, newest first; of one entity or of all."""
    some = links if entity_id is None else links.filter(F.col("entity_id") == entity_id)
    joined = some.join(records.select(F.col("id").alias("raw_record_id"), "name", "website", "phone", "source"), "raw_record_id")
    return joined.orderBy(F.col("linked_at").desc(), "entity_id", "raw_record_id")


def list_entities(entities: DataFrame, min_confidence: float = 0.0, wilaya: str | None = None, industry: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    c = F.col("confidence") >= min_confidence
    if wilaya:
        c &= F.lower("wilaya") == wilaya.lower()
    if industry:
        c &= F.lower("industry").like(f"%{industry.lower()}%")
    return page(entities.filter(c), [F.col("confidence").desc(), F.col("last_resolved_at").desc_nulls_last(), F.col("id")], limit, offset)


def newest(df: DataFrame, limit: int = 1000, offset: int = 0) -> DataFrame:
    return page(df, [F.col("created_at").desc_nulls_last(), F.col("id")], limit, offset)


def unresolved(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records that no entity links to yet."""
    return records.join(links.select(F.col("raw_record_id").alias("id")), "id", "left_anti")


def attachments_of(attachments: DataFrame, raw_record_id: int) -> DataFrame:
    return attachments.filter(F.col("raw_record_id") == raw_record_id).orderBy(F.col("created_at").desc(), "id")


def by_id(df: DataFrame, id_: int) -> DataFrame:
    return df.filter(F.col("id") == id_)
