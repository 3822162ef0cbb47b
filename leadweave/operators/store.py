"""Snapshots and upserts. Parquet tables know no UPDATE, so every change is a function (existing, incoming) -> merged,
and a merged table is written as a new snapshot beside the old one before it takes its place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave import schemas
from leadweave.functions import urls
from leadweave.functions.text import fingerprint


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order: an aggregate with map-side combine, so that a hot key costs no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*").select(*df.columns)


def last_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*").select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], *, replace: Iterable[str] = (), fill: Iterable[str] = (), computed: dict[str, Column] | None = None) -> DataFrame:
    """Insert-or-update on ``keys``; ``incoming`` has at most one row a key.

    Of a key on both sides, ``replace`` columns come from the incoming row (nulls too), ``fill`` columns only where the
    existing value is null, others stay. ``computed`` gives expressions over ``old.c``, ``new.c``, ``old.here`` and
    ``new.here``. Columns that the incoming rows lack are null in new rows."""
    for c in existing.columns:
        if c not in incoming.columns:
            incoming = incoming.withColumn(c, F.lit(None).cast(existing.schema[c].dataType))
    old, new = existing.withColumn("here", F.lit(True)).alias("old"), incoming.withColumn("here", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    both = old.join(new, on, "full_outer")
    computed, replace, fill = computed or {}, set(replace), set(fill)
    out = []
    for c in existing.columns:
        mine, theirs = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in computed:
            made = computed[c]
        elif c in keys or c in fill:
            made = F.coalesce(mine, theirs)
        elif c in replace:
            made = F.when(F.col("new.here"), theirs).otherwise(mine)
        else:
            made = F.when(F.col("old.here"), mine).otherwise(theirs)
        out.append(made.cast(existing.schema[c].dataType).alias(c))
    return both.select(*out)


def new_id(*keys: Column) -> Column:
    """A non-negative id from a row's identity: needs no counter that all tasks would have to share."""
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 63) - 1))


#: What a second sighting of a record changes.
SEEN_AGAIN = ("last_updated", "relative_age_hint", "calculated_age_class", "rating", "review_count", "phone_metadata")


def save_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Raw records by fingerprint: a known one keeps identity, discovery and creation, and takes the six fields of SEEN_AGAIN.

    Of incoming rows with one fingerprint the latest sighting counts, a tie broken by name."""
    one = last_of_each(incoming, ["fingerprint"], [F.col("last_updated"), F.col("name")])
    return upsert(existing, one, ["fingerprint"], replace=SEEN_AGAIN, computed={"id": F.coalesce("old.id", "new.id", new_id(F.col("new.fingerprint")))})


def save_summary(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: how many fingerprints a save inserts and updates, and how many incoming rows repeat another."""
    keys = incoming.groupBy("fingerprint").agg(F.count("*").alias("n"))
    known = keys.join(existing.select("fingerprint", F.lit(1).alias("known")), "fingerprint", "left")
    return known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("discovered"), F.count(F.when(F.col("known").isNull(), 1)).alias("inserted"), F.count("known").alias("updated"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def save_manual(records: DataFrame, scores: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """A hand-made lead (records with ``tags``): fills nulls of a known record; its score row starts ``verified``, later only tags change."""
    merged = upsert(records, incoming.drop("tags"), ["fingerprint"], fill=("address", "website", "phone", "email"), computed={"id": F.coalesce("old.id", "new.id", new_id(F.col("new.fingerprint")))})
    tags = merged.join(incoming.select("fingerprint", "tags"), "fingerprint").select(F.col("id").alias("raw_record_id"), F.lit(0.0).alias("priority_score"), F.lit("verified").alias("status"), "tags", now.alias("computed_at"), F.lit(False).alias("is_contact"))
    return merged, upsert(scores, tags, ["raw_record_id"], replace=("tags",))


def save_scores(scores: DataFrame, incoming: DataFrame) -> DataFrame:
    """Scores (raw_record_id, priority_score, score_breakdown, computed_at): status becomes scored unless contacted or rejected."""
    status = F.when(F.col("new.here") & ~F.coalesce(F.col("old.status").isin("contacted", "rejected"), F.lit(False)), "scored").otherwise(F.col("old.status"))
    return upsert(scores, incoming, ["raw_record_id"], replace=("priority_score", "score_breakdown", "computed_at"), computed={"status": status, "is_contact": F.coalesce("old.is_contact", F.lit(False))})


def attach_analyses(analyses: DataFrame, scores: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Analyses replace what is there, and force the status to analyzed."""
    merged = upsert(analyses, incoming, ["raw_record_id"], replace=[c for c in incoming.columns if c != "raw_record_id"])
    return merged, set_fields(scores, incoming.select("raw_record_id"), now, status="analyzed", touch=False)


def set_fields(scores: DataFrame, ids: DataFrame, now: Column, *, status: str | None = None, is_contact: bool | None = None, touch: bool = True) -> DataFrame:
    """Set status or contact flag of many leads at once; missing score rows are made with score 0. ``touch`` renews computed_at."""
    given = {k: F.lit(v) for k, v in (("status", status), ("is_contact", is_contact)) if v is not None}
    incoming = ids.select("raw_record_id").distinct().select("raw_record_id", F.lit(0.0).alias("priority_score"), *[v.alias(k) for k, v in given.items()], now.alias("computed_at"))
    computed = {k: F.when(F.col("old.here"), F.coalesce(F.col(f"old.{k}"), F.lit(v))).otherwise(F.lit(v)) for k, v in (("status", "discovered"), ("is_contact", False)) if k not in given}
    return upsert(scores, incoming, ["raw_record_id"], replace=[*given, *(["computed_at"] if touch else [])], computed=computed)


def set_tags(scores: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Tags (raw_record_id, tags) of leads; missing score rows are made."""
    rows = incoming.select("raw_record_id", "tags", F.lit(0.0).alias("priority_score"), F.lit("discovered").alias("status"), F.lit(False).alias("is_contact"), now.alias("computed_at"))
    return upsert(scores, rows, ["raw_record_id"], replace=("tags",))


def edit_records(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Overwrite name, address, website, phone and email (nulls too) of known ids; the fingerprint stays as it was."""
    fields = ("name", "address", "website", "phone", "email")
    made = edits.select(F.col("id").alias("edit_id"), *[F.col(c).alias(f"edit_{c}") for c in fields])
    return records.join(made, records["id"] == made["edit_id"], "left").select(*[F.when(F.col("edit_id").isNotNull(), F.col(f"edit_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in records.columns])


def save_entities(entities: DataFrame, links: DataFrame, incoming: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Entities by id; the phone is the first of phones. An entity with records gets its links anew, each record once."""
    rows = incoming.withColumn("phone", F.get("phones", F.lit(0)))
    merged = upsert(entities, rows, ["id"], replace=[c for c in rows.columns if c != "id"])
    linked = rows.filter(F.size("raw_record_ids") > 0)
    fresh = linked.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct("raw_record_ids")).alias("raw_record_id"), F.col("confidence").alias("match_score"))
    fresh = fresh.select(new_id(F.col("entity_id"), F.col("raw_record_id")).alias("id"), "entity_id", "raw_record_id", "match_score", F.array().cast("array<string>").alias("match_reasons"), now.alias("linked_at"))
    kept = links.join(linked.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(*links.columns)
    return merged, kept.unionByName(fresh)


def enqueue(queue: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The rows to add for URLs (url, priority, depth): those with a host and not yet queued, each once, the most urgent first."""
    rows = incoming.withColumn("domain", urls.host(F.col("url"))).filter(F.col("domain") != "")
    one = first_of_each(rows, ["url"], [-F.col("priority"), F.col("depth")])
    fresh = one.join(queue.select("url"), "url", "left_anti")
    made = {"id": new_id(F.col("url")), "status": F.lit("pending"), "last_attempted": F.lit(None), "fail_count": F.lit(0), "created_at": now}
    return fresh.select(*[(made[c] if c in made else F.col(c)).cast(schemas.TABLES["crawl_queue"][c].dataType).alias(c) for c in queue.columns])


def add_campaign(campaigns: DataFrame, query: str, wilaya: str | None, limit: int, now: Column) -> DataFrame:
    row = campaigns.sparkSession.range(1).select(new_id(F.lit(query), F.lit(wilaya or ""), now.cast("string")).alias("id"), F.lit(query).alias("query"), F.lit(wilaya).cast("string").alias("wilaya"), F.lit(limit).alias("limit_num"), F.lit("pending").alias("status"), F.lit(0).alias("discovered_qty"), F.lit(0).alias("saved_qty"), now.alias("created_at"), now.alias("updated_at"))
    return campaigns.unionByName(row)


def set_campaign(campaigns: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Changes (id, status, discovered_qty, saved_qty; quantities default to 0) of campaigns."""
    rows = changes.select("id", "status", F.coalesce("discovered_qty", F.lit(0)).alias("discovered_qty"), F.coalesce("saved_qty", F.lit(0)).alias("saved_qty"), now.alias("updated_at"))
    merged = upsert(campaigns, rows, ["id"], replace=("status", "discovered_qty", "saved_qty", "updated_at"))
    return merged.filter(F.col("query").isNotNull())


def without(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not among ``ids``: the delete of a snapshot."""
    return df.join(ids.select(key), key, "left_anti").select(*df.columns)


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(F.col("name"), F.col("wilaya"), F.col("phone"), F.col("website")))


class Store:
    """Tables as numbered snapshots under one folder; the highest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def version(self, table: str) -> int:
        at = self._path(f"{self.path}/{table}")
        if not self._fs.exists(at):
            return 0
        found = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n[1:]) for n in found if n[:1] == "v" and self._fs.exists(self._path(f"{self.path}/{table}/{n}/_SUCCESS"))), default=0)

    def read(self, table: str) -> DataFrame:
        """The current snapshot, upgraded and with defaults; none yet: an empty table."""
        v = self.version(table)
        if not v:
            return schemas.empty(self.spark, table)
        df = schemas.MIGRATIONS.upgrade(self.spark.read.parquet(f"{self.path}/{table}/v{v}"), table)
        return schemas.with_defaults(df, table).select(*schemas.TABLES[table].fieldNames())

    def write(self, table: str, df: DataFrame, keep: int = 2) -> int:
        """Write the next snapshot; all but the last ``keep`` go."""
        v = self.version(table) + 1
        df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[table]]).write.mode("overwrite").parquet(f"{self.path}/{table}/v{v}")
        for old in range(1, v - keep + 1):
            self._fs.delete(self._path(f"{self.path}/{table}/v{old}"), True)
        return v

    def clear(self, table: str) -> int:
        """Empty a table; returns how many rows it had."""
        n = self.read(table).count()
        self.write(table, schemas.empty(self.spark, table))
        return n

    def compact(self, table: str, files: int = 1) -> int:
        """Rewrite the current snapshot in fewer files."""
        return self.write(table, self.read(table).repartition(files))

    def faults(self, table: str, key: str | None = None) -> DataFrame:
        """Rows that break a check of the table, and those that repeat its key."""
        _, bad = schemas.split_valid(self.read(table), table)
        found = bad.select(F.explode("faults").alias("fault"))
        if key:
            found = found.unionByName(self.read(table).groupBy(key).count().filter("count > 1").select(F.lit(f"repeated {key}").alias("fault")))
        return found.groupBy("fault").count()
