"""Exact deduplication by Grace hash partitioning.

Three steps, none of which gathers a group of copies in one task:

1. every scan task folds its own rows into an open-addressing table that compares complete contents and
   passes on one representative per distinct content with the group's count and largest id (written once
   to the shared folder);
2. representatives are partitioned by hash, recursively: the sizes of the buckets of a level are measured and
   every bucket over ``bucket_bytes`` is partitioned again by further digits of its hash. The leaves are dealt
   out by one exchange, whose sorted shuffle files are the spill files of the method; a task then loads one leaf
   after the other into an open-addressing table;
3. the verdict on each representative is joined to the rows it stands for.

A content that fills a third of the table reaches step 2 once per flushed table of step 1, not once per row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import LOWER, UPPER, arrow_limits, parts, table, write_shared

#: Bytes of content that one open-addressing table may hold.
BUCKET_BYTES = 16 << 20
FAN_OUT = 16
#: Tasks of the exchange of leaves, at most, as a multiple of the session's shuffle partitions; a task takes leaf after leaf.
TASKS = 4
#: Digits of the 64-bit hash that recursion may use.
MAX_LEVEL = 8


class ContentTable:
    """Open addressing with linear probing; a slot is taken only by an equal hash and equal complete content."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.contents)

    def add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def content_of(text: bytes | None) -> bytes:
    """Null counts as empty; bytes.lower() touches A-Z alone."""
    return b"" if text is None else text.lower()


def _above(a, b) -> bool:
    """Order of ids: null below everything."""
    return a is not None and (b is None or a > b)


def _fold(budget: int):
    """Step 1 of the module: rows of one task to members and local representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq, held = TaskContext.get().partitionId() << 36, 0, []
        found, ids, entry = ContentTable(), [], []
        count: list[int] = []
        best: list[int] = []

        def flush():
            nonlocal seq
            rows = pa.Table.from_batches(held)
            top = set(best)
            local = [i in top for i in range(len(ids))]
            cols = {
                "id": rows.column(0),
                "rep": pa.array([base + seq + e for e in entry], pa.int64()),
                "top": pa.array(local, pa.bool_()),
                "hash": pa.array([_signed(found.hashes[e]) for e in entry], pa.int64()),
                "n": pa.array([count[e] for e in entry], pa.int64()),
            }
            if rows.num_columns > 2:
                # rows that may stay go on with all their columns, the content among them
                keep = pa.array([i if t else None for i, t in enumerate(local)], pa.int64())
                cols["row"] = rows.column(2).combine_chunks().take(keep)
            else:
                cols["content"] = pa.array([found.contents[e] if t else None for e, t in zip(entry, local)], pa.binary())
            seq += len(found)
            yield from pa.table(cols).to_batches(max_chunksize=2000)

        for b in batches:
            held.append(b)
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                content, at = content_of(t), len(ids)
                e, new = found.add(xxhash.xxh64_intdigest(content), content)
                ids.append(i)
                entry.append(e)
                if new:
                    count.append(1)
                    best.append(at)
                else:
                    count[e] += 1
                    if _above(i, ids[best[e]]):
                        best[e] = at
            if sum(x.nbytes for x in held) > budget:
                yield from flush()
                held, found, ids, entry, count, best = [], ContentTable(), [], [], [], []
        if held:
            yield from flush()

    return run


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _leaf_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: rows (leaf, rep, id, n, hash, content) sorted by leaf to one verdict for each representative."""
    leaf, found, groups = None, ContentTable(), []

    def verdicts():
        out = {k: [] for k in ("rep", "keep_id", "group_size", "wins", "sha256")}
        for content, (size, keep, _, reps, winner) in zip(found.contents, groups):
            sha = hashlib.sha256(content).hexdigest()
            for r in reps:
                for k, v in zip(out, (r, keep, size, r == winner, sha)):
                    out[k].append(v)
        if groups:
            yield pa.RecordBatch.from_pydict(out, schema=_verdict_arrow(keep_type))

    keep_type = pa.int64()
    for b in batches:
        keep_type = b.schema.field("id").type
        d = b.to_pydict()
        for at, rep, i, n, h, content in zip(d["leaf"], d["rep"], d["id"], d["n"], d["hash"], d["content"]):
            if at != leaf:
                yield from verdicts()
                leaf, found, groups = at, ContentTable(), []
            e, new = found.add(h & (1 << 64) - 1, content_of(content))
            if new:
                groups.append([n, i, rep, [rep], rep])
            else:
                g = groups[e]
                g[0] += n
                g[3].append(rep)
                if _above(i, g[1]) or i == g[1] and rep < g[4]:
                    g[1], g[4] = i, rep
    yield from verdicts()


def _verdict_arrow(id_type) -> pa.Schema:
    return pa.schema([("rep", pa.int64()), ("keep_id", id_type), ("group_size", pa.int64()), ("wins", pa.bool_()), ("sha256", pa.string())])


def leaf_column(reps: DataFrame, bucket_bytes: int) -> tuple[Column, int]:
    """Partition recursively until every bucket fits: the leaf of a row as an expression, and the number of first buckets.

    Only the names of buckets that are too large come to the driver: with a uniform hash and copies folded, those are
    the buckets of a few very long contents."""
    total = reps.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    first = max(1, math.ceil(1.5 * total / bucket_bytes))
    leaf = F.pmod(F.shiftrightunsigned(F.col("hash"), 1), F.lit(first)).cast("string")
    for level in range(1, MAX_LEVEL + 1):
        over = [r[0] for r in reps.groupBy(leaf.alias("leaf")).agg(F.sum(F.octet_length("content")).alias("b"), F.min("hash").alias("lo"), F.max("hash").alias("hi")).filter((F.col("b") > bucket_bytes) & (F.col("lo") != F.col("hi"))).select("leaf").collect()]
        if not over:
            break
        # a digit of the hash that no level before has used
        digit = F.pmod(F.xxhash64(F.lit(level), F.col("hash")), F.lit(FAN_OUT)).cast("string")
        leaf = F.when(leaf.isin(over), F.concat_ws(".", leaf, digit)).otherwise(leaf)
    return leaf, first


def grace_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, whole_rows: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha256 (and ``row``, the input row, where it is kept and asked for).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are copies of
    each other. Of equal texts the row with the largest id stays; of repeated rows with that id exactly one. A null id
    is below all others. An empty table gives an empty result. Other columns play no part, whatever their names."""
    spark = df.sparkSession
    arrow_limits(spark)
    id_type = df.schema[id_col].dataType
    inputs = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")]
    fields = [T.StructField("id", id_type), T.StructField("rep", T.LongType()), T.StructField("top", T.BooleanType()), T.StructField("hash", T.LongType()), T.StructField("n", T.LongType())]
    content = F.col("content")
    if whole_rows:
        inputs.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        fields.append(T.StructField("row", df.select(inputs[-1]).schema[0].dataType))
        content = F.col(f"row.`{text_col}`").cast("binary")
    else:
        fields.append(T.StructField("content", T.BinaryType()))
    folded = write_shared(df.select(*inputs).mapInArrow(_fold(bucket_bytes), T.StructType(fields)), "grace-fold")
    reps = folded.filter("top").select("rep", "id", "n", "hash", content.alias("content"))
    leaf, first = leaf_column(reps, bucket_bytes)
    tasks = min(first, TASKS * parts(spark))
    verdict_type = T.StructType([T.StructField("rep", T.LongType()), T.StructField("keep_id", id_type), T.StructField("group_size", T.LongType()), T.StructField("wins", T.BooleanType()), T.StructField("sha256", T.StringType())])
    verdicts = (
        reps.withColumn("leaf", leaf)
        # first-level leaves are dealt out in turn, several to a task where there are more of them than tasks; parts of split ones go anywhere
        .repartitionById(tasks, F.pmod(F.when(F.col("leaf").contains("."), F.xxhash64("leaf")).otherwise(F.col("leaf").cast("long")), F.lit(tasks)).cast("int"))
        .sortWithinPartitions("leaf")
        .select("leaf", "rep", "id", "n", "hash", "content")
        .mapInArrow(_leaf_tables, verdict_type)
    )
    members = folded.select("id", "rep", "top", *(["row"] if whole_rows else []))
    return members.join(verdicts, "rep").select("id", "keep_id", "group_size", (F.col("top") & F.col("wins")).alias("kept"), "sha256", *(["row"] if whole_rows else []))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return grace_dedup(df, id_col, text_col, whole_rows=True).filter("kept").select("row.*")


def op6_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


SQL = {
    "op6_grace_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY t.norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm"""
}
QUERIES = {"op6_grace_dedup": op6_grace_dedup}
