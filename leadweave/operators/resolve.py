"""Entity resolution: trigram blocks, pair scores, components, golden records.

Blocks are counted before they are joined, and those over the cap never are, so the self-join is linear in the data. Pairs
are reduced to distinct ids before any attribute is fetched. Only records with an edge enter the iteration.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.text import edit_ratio, jaccard, trigrams, web_key
from leadweave.functions.values import merge_confidence
from leadweave.operators.components import connected_components
from leadweave.operators.leads import resolver_view


@dataclass(frozen=True)
class ResolverConfig:
    max_block: int = 100
    name_threshold: float = 0.78
    edge_threshold: float = 0.65
    name: float = 0.40
    website: float = 0.25
    phone: float = 0.20
    email: float = 0.15


def blocks(records: DataFrame) -> DataFrame:
    """(block, id): a record's trigrams, or the block of short names."""
    return records.select("id", F.explode(trigrams(F.col("name"))).alias("block"))


def block_sizes(records: DataFrame) -> DataFrame:
    return blocks(records).groupBy("block").agg(F.count("*").alias("n"))


def candidate_pairs(records: DataFrame, max_block: int = 100) -> DataFrame:
    """(a, b), a < b, that share a block of 2 to ``max_block`` records; each pair once."""
    members = blocks(records)
    fit = block_sizes(records).filter(F.col("n").between(2, max_block)).select("block")
    kept = members.join(fit, "block")
    # at most max_block members each, so a block's list is small and its pairs are bounded
    lists = kept.groupBy("block").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    firsts = lists.select("ids", F.posexplode("ids").alias("pos", "a"))
    return firsts.select("a", F.explode(F.slice(F.col("ids"), F.col("pos") + 2, F.size("ids"))).alias("b")).filter("a < b").distinct()


def match_score(cfg: ResolverConfig = ResolverConfig()) -> dict[str, Column]:
    """Columns ``name_score, website_score, phone_score, email_score, score, reasons`` over columns a_* and b_*.

    Sites and addresses count 1 if equal, 0.5 if both are missing; phones by overlap, 0.5 if both are missing, 0.3 if one
    is. The weighted sum is taken in this order, as the threshold can lie on its rounding."""
    name = edit_ratio(F.col("a_name"), F.col("b_name"))

    def exact(x: Column, y: Column) -> Column:
        return F.when((x != "") & (y != ""), F.when(x == y, 1.0).otherwise(0.0)).when((x == "") & (y == ""), 0.5).otherwise(0.0)

    web = exact(web_key(F.col("a_website")), web_key(F.col("b_website")))
    mail = exact(*[F.lower(F.trim(F.coalesce(F.col(f"{s}_email"), F.lit("")))) for s in "ab"])
    pa, pb = F.size("a_phones") > 0, F.size("b_phones") > 0
    phone = F.when(pa & pb, jaccard(F.col("a_phones"), F.col("b_phones"))).when(~pa & ~pb, 0.5).otherwise(0.3)
    n, w, p, m = (F.col(c) for c in ("name_score", "website_score", "phone_score", "email_score"))
    reasons = F.array(
        F.when(n >= cfg.name_threshold, F.concat(F.lit("name:"), F.format_string("%.2f", n))), F.when(w > 0.9, "website:exact"),
        F.when(p > 0, F.concat(F.lit("phone:"), F.format_string("%.2f", p))), F.when(m > 0.9, "email:exact"),
    )
    return {"name_score": name, "website_score": web, "phone_score": phone, "email_score": mail, "score": n * cfg.name + w * cfg.website + p * cfg.phone + m * cfg.email, "reasons": F.filter(reasons, lambda r: r.isNotNull())}


def scored_pairs(records: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Candidate pairs (a, b) with their scores and reasons."""
    view = resolver_view(records).select("id", "name", "website", "phones", "email")
    sides = [view.select(*[F.col(c).alias(s if c == "id" else f"{s}_{c}") for c in view.columns]) for s in "ab"]
    scores = match_score(cfg)
    joined = candidate_pairs(records, cfg.max_block).join(sides[0], "a").join(sides[1], "b")
    parts = ["name_score", "website_score", "phone_score", "email_score"]
    return joined.withColumns({k: scores[k] for k in parts}).select("a", "b", *parts, scores["score"].alias("score"), scores["reasons"].alias("reasons"))


def edges(records: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    return scored_pairs(records, cfg).filter(F.col("score") >= cfg.edge_threshold)


def clusters(records: DataFrame, cfg: ResolverConfig = ResolverConfig()) -> DataFrame:
    """(id, cluster): the smallest id of the component; records without an edge are their own."""
    roots = connected_components(edges(records, cfg).select("a", "b"))
    return records.select("id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def completeness() -> Column:
    """Filled fields among seven, and the numbers of socials and validated phones."""
    filled = sum((F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in ("name", "address", "website", "phone", "email", "industry", "wilaya")), F.lit(0))
    return filled + F.coalesce(F.size("social_media_handles"), F.lit(0)) + F.coalesce(F.size("phone_metadata"), F.lit(0))


def golden_records(records: DataFrame, members: DataFrame) -> DataFrame:
    """One entity a cluster: identity of the most complete record (the smaller id among equals), the longest address,
    site and e-mail (likewise), the best rating, all phones and socials sorted, ids ascending. A single record keeps its
    own socials in order and its plain phone alone."""
    rows = records.join(members, "id")
    none = F.array().cast("array<string>")
    meta = F.coalesce(F.transform("phone_metadata", lambda p: p["e164"]), none)
    plain = F.when(F.coalesce(F.col("phone"), F.lit("")) != "", F.array("phone")).otherwise(none)

    def longest(c: str) -> Column:
        full = F.when(F.col(c) != "", F.col(c))
        return F.max_by(full, F.when(full.isNotNull(), F.struct(F.length(full), -F.col("id"))))

    best = F.max_by(F.struct("name", "industry", "wilaya", "latitude", "longitude"), F.struct(completeness(), -F.col("id")))
    merged = rows.groupBy("cluster").agg(
        F.count("*").alias("n"), best.alias("base"), *[longest(c).alias(c) for c in ("address", "website", "email")], F.max(F.coalesce("rating", F.lit(0.0))).alias("rating"),
        F.max(F.coalesce("review_count", F.lit(0))).alias("review_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct(F.concat(plain, meta)))))).alias("all_phones"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("social_media_handles", none))))).alias("all_socials"), F.array_sort(F.collect_list("id")).alias("raw_record_ids"),
        F.first(plain).alias("one_phone"), F.first(F.coalesce("social_media_handles", none)).alias("one_socials"),
    )
    alone = F.col("n") == 1
    return merged.select(
        F.col("cluster").alias("id"), F.lit("business").alias("entity_type"), "base.name", "base.industry", "base.wilaya", "address", "website",
        F.get(F.when(alone, F.col("one_phone")).otherwise(F.col("all_phones")), F.lit(0)).alias("phone"), "email", F.when(alone, F.col("one_socials")).otherwise(F.col("all_socials")).alias("social_media_handles"),
        F.when(alone, F.col("one_phone")).otherwise(F.col("all_phones")).alias("phones"), "rating", "review_count", "base.latitude", "base.longitude", merge_confidence(F.col("n")).alias("confidence"),
        F.when(alone, "single").otherwise("graph_merge").alias("strategy"), "raw_record_ids",
    )


def resolve(records: DataFrame, cfg: ResolverConfig = ResolverConfig(), newest: int | None = None) -> DataFrame:
    """Entities of all records, or of the newest so many."""
    if newest is not None:
        records = records.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(newest)
    return golden_records(records, clusters(records, cfg))


def resolution_summary(records: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: records in, entities out, and the ratio."""
    return records.agg(F.count("*").alias("input_records")).crossJoin(entities.agg(F.count("*").alias("output_entities"))).withColumn("compression", F.when(F.col("input_records") > 0, 1 - F.col("output_entities") / F.col("input_records")).otherwise(0.0))
