"""Line deduplication on levelled sorted runs of line hashes, with DataFrame functions only.

Documents arrive in batches of ascending ids. The index is a set of *runs*: tables (k1, k2, owner) in as many buckets of the
128-bit hash of a line key, each bucket one file sorted by it, with one owner (the smallest document that holds the key) per
key. So a batch is exchanged once and merged with all runs, and runs are merged with each other where they lie. A batch

1. reduces its lines to one row per key, the smallest document that holds it (partial aggregation first, so a line that
   every document repeats is folded before the exchange),
2. merge-anti-joins these keys with every run, so that keys already owned are left out, and
3. writes what remains as a new run of level 0.

Whenever a level holds ``fan_out`` runs they are merged into one run of the next level, so a batch meets at most
fan_out - 1 runs per level, and a key is rewritten once per level.

A line is dropped where its key's owner is another document. That is settled by one join between all lines and the
keys owned by another document's batch or by a smaller document of the batch, after the last batch.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm._shared import LOWER, UPPER, lower_ascii, parts, shared_path, table, write_shared

MIN_KEY = 10
#: Batches, at least, and lines of a batch, about.
BATCHES = 4
BATCH_LINES = 1 << 31
FAN_OUT = 2
#: [\x20\x09-\x0D]
BLANK = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def _lines(docs: DataFrame, min_key: int) -> DataFrame:
    """(id, version, pos, k1, k2) of the lines whose keys are long enough to count; rows that repeat an id differ in version."""
    lines = docs.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    return lines.select("id", "version", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))


class Run:
    """A run as a bucketed, sorted table (``keys``: k1, k2, owner) for merges without an exchange, and as plain files."""

    def __init__(self, keys: DataFrame, n: int):
        spark = keys.sparkSession
        path = shared_path(spark, "line-run")
        name = "line_run_" + uuid.uuid4().hex
        keys.write.bucketBy(n, "k1", "k2").sortBy("k1", "k2").option("path", path).format("parquet").saveAsTable(name)
        self.keys = spark.table(name)
        self.plain = spark.read.schema(self.keys.schema).parquet(path)
        # the files are not the table's own, and the plans above do not need its name
        spark.sql(f"DROP TABLE {name}")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs, disjoint in their keys, into one: a sort-merge over buckets that lie side by side."""
    return a.withColumnRenamed("owner", "owner_a").join(b.withColumnRenamed("owner", "owner_b"), ["k1", "k2"], "full_outer").select("k1", "k2", F.coalesce("owner_a", "owner_b").alias("owner"))


class Runs:
    """The levelled index. ``levels[i]`` lists the runs of level i, all disjoint in their keys."""

    def __init__(self, n_parts: int, fan_out: int = FAN_OUT):
        self.n_parts, self.fan_out = n_parts, fan_out
        self.levels: list[list[Run]] = []

    def all(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def new(self, keys: DataFrame) -> DataFrame:
        """The batch's keys (k1, k2, owner) that no run holds."""
        dealt = keys.repartition(self.n_parts, "k1", "k2")
        return reduce(lambda k, run: k.join(run.keys.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti"), self.all(), dealt)

    def add(self, keys: DataFrame) -> None:
        """Add what is new of a batch as a run, and compact full levels."""
        self._put(0, Run(self.new(keys), self.n_parts))

    def _put(self, level: int, run: Run) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            merged = reduce(lambda a, b: merge(a, b.hint("merge")), [r.keys for r in self.levels[level]])
            self.levels[level] = []
            self._put(level + 1, Run(merged, self.n_parts))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_key: int = MIN_KEY, batches: int | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per input row: id, text (what is kept of it), n_lines (before dropping), n_dropped.

    Keys of at least ``min_key`` code points lose all their lines except in the smallest id that holds them; the lines
    kept are joined by newlines. Null and empty texts are one empty line. Rows with a null id keep all their lines and
    own none. Repeated rows with one id are one document for ownership, and each keeps its lines. An empty table gives an
    empty result; other columns play no part. Ids are integers. Keys are compared by 128 bits of hash."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    lines = write_shared(_lines(docs.filter("id IS NOT NULL"), min_key), "lines")
    if batches is None:
        batches = max(BATCHES, math.ceil(lines.count() / BATCH_LINES))
    # batches are ranges of ids, so that the first batch that brings a key also has its smallest document
    cuts = sorted({c for c in docs.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    bounds = [None, *map(int, cuts), None]
    # a bucket is one sorted file: its order is known to the merges
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    runs = Runs(parts(spark), fan_out)
    for lo, hi in zip(bounds, bounds[1:]):
        batch = lines
        if lo is not None:
            batch = batch.filter(F.col("id") > lo)
        if hi is not None:
            batch = batch.filter(F.col("id") <= hi)
        runs.add(batch.groupBy("k1", "k2").agg(F.min("id").alias("owner")))
    # as plain files, so that both sides are exchanged, and a line that very many documents hold can be split
    owners = reduce(DataFrame.unionByName, [r.plain for r in runs.all()])
    dropped = lines.join(owners, ["k1", "k2"]).filter(F.col("id") > F.col("owner")).groupBy("id", "version").agg(F.array_distinct(F.array_sort(F.collect_list("pos"))).alias("drop"))
    out = docs.join(dropped, ["id", "version"], "left").select("id", F.split("text", "\n", -1).alias("line"), F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
    out = out.select("id", "line", F.size("line").alias("n_lines"), F.array_except(F.sequence(F.lit(0), F.size("line") - 1), "drop").alias("kept"))
    return out.select("id", F.array_join(F.transform("kept", lambda p: F.col("line")[p]), "\n").alias("text"), F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op2_line_runs": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {MIN_KEY} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
QUERIES = {"op2_line_runs": op2_line_runs}
