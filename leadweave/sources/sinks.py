"""Exports: leads as CSV and JSON, entities as JSON, and the reply cache."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.functions.text import cache_key
from leadweave.operators.leads import detail, list_leads

CSV_COLUMNS = ("id", "name", "industry", "wilaya", "address", "website", "phone", "email", "rating", "review_count", "source", "priority_score", "status", "freshness", "discovered_at")


def csv_rows(view: DataFrame, limit: int = 1000) -> DataFrame:
    """The top leads with the fifteen columns of the export."""
    return list_leads(view, limit=limit).withColumn("freshness", F.col("calculated_age_class")).select(*CSV_COLUMNS)


def stamped(folder: str, name: str, now: datetime) -> str:
    return f"{folder.rstrip('/')}/{name}_{now:%Y%m%d_%H%M%S}"


def export_leads_csv(view: DataFrame, folder: str, now: datetime, limit: int = 1000) -> str:
    """One CSV file with a header: the export is a bounded top list. Returns its folder."""
    path = stamped(folder, "leads", now)
    csv_rows(view, limit).coalesce(1).write.option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def export_leads_json(view: DataFrame, folder: str, now: datetime, limit: int = 1000) -> str:
    path = stamped(folder, "leads_json", now)
    detail(list_leads(view, limit=limit)).coalesce(1).write.json(path)
    return path


def export_entities_json(entities: DataFrame, folder: str, now: datetime, limit: int = 1000) -> str:
    path = stamped(folder, "entities", now)
    entities.orderBy(F.col("confidence").desc(), "id").limit(limit).coalesce(1).write.json(path)
    return path


def cache_rows(replies: DataFrame) -> DataFrame:
    """Replies (model, prompt, reply) as cache rows (shard, key, reply)."""
    keyed = replies.withColumn("key", cache_key(F.col("model"), F.col("prompt")))
    return keyed.select(F.substring("key", 1, 2).alias("shard"), "key", "reply")


def write_cache(replies: DataFrame, path: str, batch: str = "") -> None:
    """Append replies (model, prompt, reply); ``batch`` names the call that asked for them."""
    cache_rows(replies).withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("shard").parquet(path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache rows (shard, key, reply, batch); none yet: an empty table. Keys repeat where two calls asked at once."""
    schema = "key string, reply string, batch string, shard string"
    fs, at = _folder(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def clear_cache(spark: SparkSession, path: str) -> int:
    """Delete all cached replies; returns how many there were."""
    n = read_cache(spark, path).count()
    fs, at = _folder(spark, path)
    fs.delete(at, True)
    return n
