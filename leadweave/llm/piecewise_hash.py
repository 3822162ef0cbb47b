"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over a window of WINDOW bytes; where its low bits are all ones a chunk ends. A text's block size is the
number of bytes that a chunk has on average, chosen so that the signature has some tens of chunks; each chunk
contributes one character of it. A fingerprint holds the signatures at its block size and at twice that, so texts whose
block sizes differ by a factor of two can still be compared, at the size they share. An edit changes the chunks that it
touches and no others, as boundaries depend on nothing but the window before them.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, parts, table

WINDOW = 7
SMALLEST = 4
#: Chunks that the block size aims at, at most, and below which it is halved.
CHUNKS = 64
#: Signatures without a common run of this many characters (or of the shorter one) are unlike.
RUN = 5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Keys drawn for each range that rows are dealt out by, about.
KEYS_PER_RANGE = 64
#: Bytes hashed at a time: bounds the arrays of a long text.
STEP = 1 << 20


def _rolling(data: bytes) -> np.ndarray:
    """Hash of the window that ends at each byte (shorter windows at the start)."""
    b = np.frombuffer(data, np.uint8)
    out = np.empty(len(b), np.uint32)
    for lo in range(0, len(b), STEP):
        head = max(0, lo - WINDOW + 1)
        part = b[head : lo + STEP].astype(np.uint32) + np.uint32(1)
        h, factor = part.copy(), 1
        for k in range(1, WINDOW):
            factor = factor * 0x01000193 & 0xFFFFFFFF
            if len(part) > k:
                h[k:] += part[:-k] * np.uint32(factor)
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out[lo : lo + STEP] = h[lo - head :]
    return out


def _signature(data: bytes, ends: np.ndarray) -> str:
    view, last, out = memoryview(data), 0, []
    for end in [*(ends + 1).tolist(), len(data)]:
        if end > last:
            out.append(ALPHABET[zlib.crc32(view[last:end]) >> 9 & 63])
            last = end
    return "".join(out)


def fingerprint(text: bytes | None) -> str:
    """``block:signature:signature at twice the block``; null counts as empty. Equal texts have equal fingerprints."""
    data = text or b""
    block = SMALLEST
    while block * CHUNKS < len(data):
        block *= 2
    h = _rolling(data)
    ends = np.flatnonzero(h & np.uint32(block - 1) == block - 1)
    while block > SMALLEST and len(ends) < CHUNKS // 2 - 1:
        block //= 2
        ends = np.flatnonzero(h & np.uint32(block - 1) == block - 1)
    twice = ends[h[ends] & np.uint32(2 * block - 1) == 2 * block - 1]
    return f"{block}:{_signature(data, ends)}:{_signature(data, twice)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over the lengths' sum; 0 without a common run."""
    if not a or not b:
        return float(a == b)
    k = min(RUN, len(a), len(b))
    runs = {a[i : i + k] for i in range(len(a) - k + 1)}
    if not any(b[i : i + k] in runs for i in range(len(b) - k + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * _common(a, b)
    return 1 - distance / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: signatures are compared at each block size that both fingerprints have."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if bx == 2 * by:
        return _alike(x1, y2)
    if by == 2 * bx:
        return _alike(x2, y1)
    return 0.0


def _order(i, mark: int) -> tuple:
    """Ascending order of rows: null ids, then ids, then the text's hash."""
    return (i is not None, 0 if i is None else i, mark)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, extra, id, text, n) dealt out by ranges of (id, text's hash), descending within each, so that a row's next one follows it.

    The boundaries are keys of rows drawn at random, and the row at the head of a range comes once more, as ``extra``, at the end of
    the range before it; the very first closes the last range. A task sends rows that are equal in id and text as one, with
    their number, and each head once. So texts cross the network once, and neither repeated ids, nor null ids, nor
    repeated rows make a range larger than others."""
    spark = df.sparkSession
    n = parts(spark)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    drawn = rows.select(F.struct("id", "mark").alias("key"), (F.rand(7) < KEYS_PER_RANGE * n / max(1, df.count())).alias("hit"))
    stats = drawn.agg(F.max("key").alias("top"), F.collect_list(F.when(F.col("hit"), F.col("key"))).alias("drawn")).first()
    keys = sorted(_order(*k) for k in stats["drawn"])
    heads = sorted({*(keys[i * len(keys) // n] for i in range(1, n) if keys), *([] if stats["top"] is None else [_order(*stats["top"])])})
    last = len(heads) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            found: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist())):
                found.setdefault(key, [row, 0])[1] += 1
            out = []
            for (i, mark, _), (row, many) in found.items():
                # range p holds the keys from just above heads[last - p - 1] up to its head, heads[last - p]
                at = bisect_left(heads, _order(i, mark))
                out.append((last - at, 0, row, many))
                if heads[at] == _order(i, mark) and at not in sent:
                    sent.add(at)
                    out.append((last - at - 1 if at < last else last, 1, row, 1))
            if out:
                part, extra, at, many = zip(*out)
                some = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(extra, pa.int32()), *some.columns, pa.array(many, pa.int64())], ["part", "extra", "id", "text", "mark", "n"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("extra", T.IntegerType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("mark", T.LongType()), T.StructField("n", T.LongType())])
    dealt = rows.mapInArrow(deal, schema).repartitionById(n, F.col("part"))
    return dealt.sortWithinPartitions(F.col("part"), F.col("extra"), F.col("id").desc_nulls_last(), F.col("mark").desc(), F.col("text")).select("part", "extra", "id", "text", "n")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, in descending order of ids, the first after the last. Ids are of any type that orders. Null text counts as empty: its
    fingerprint has empty signatures, as has its edited text. Repeated ids are in descending order of their texts' hashes
    (xxhash64), null ids come after all others. A table of one
    row follows itself; an empty table gives an empty result; other columns play no part."""
    arrow_limits(df.sparkSession)

    def compared(i, chars: str, mark: str, following: str, other: str) -> tuple:
        half = len(chars) // 2
        edited = (chars[: len(chars) - half] + following[:half]).encode()
        changed = fingerprint(edited)
        return (i, len(chars), hashlib.sha256(edited).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        part, held = None, None
        for b in batches:
            out: list[tuple] = []
            for p, extra, i, text, many in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    part, held = p, None
                if extra and held is None:
                    continue
                own = fingerprint(text.encode())
                if held is not None:
                    out.append(compared(*held, text, own))
                if many > 1:
                    out += [compared(i, text, own, text, own)] * (many - 1)
                held = None if extra else (i, text, own)
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("id").type), pa.array(cols[1], pa.int64()), *map(pa.array, cols[2:])], names)

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")] + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")])
    return with_next(df, id_col, text_col).mapInArrow(run, schema)


def op8_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_piecewise_hash": op8_piecewise_hash}
