"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at most ``radius`` bits apart have a common neighbour at most radius/2 bits from either. So each
*distinct* fingerprint emits its ball of radius/2 (65 variants for radius 2), one exchange brings equal variants
together, and the fingerprints that meet at a variant are linked in a chain: all of them are within the radius of each
other, since each is within half of it of the variant. A variant meets at most as many fingerprints as its ball has
members, whatever the data, so no group of the exchange can be large. Links are deduplicated, verified, and closed to
components. Copies of one fingerprint are one node from the start.

Near copies by a similarity of shingle sets (``similar_links``) meet by the same balls, of several shorter fingerprints, and are verified.
What is similar enough but further apart than the balls reach is found by an exact search that follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, parts, table, write_shared
from leadweave.operators.components import connected_components

SEED = 42
#: Shingles hashed at a time: bounds the memory that a long text takes.
BLOCK = 1 << 15


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a whole text, in blocks: A-Z lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    n = len(words) - width + 1
    if words and n < 1:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        yield np.array([digest(join(s), SEED) for s in zip(*(words[at + k : min(at + BLOCK, n) + k] for k in range(width)))], "<u8")


def simhash(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if over half of the shingle hashes have it; no words: 0."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, width):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, schema)


def ball_masks(radius: int, width: int = 64) -> list[int]:
    """XOR masks with at most ``radius`` of the lowest ``width`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(classes: DataFrame, radius: int, width: int = 64) -> DataFrame:
    """Links (a, b) between representatives of classes (rep, fp) whose fingerprints, of ``width`` bits, differ in at most ``radius`` bits.
    The bits of fp above those have to be equal: they tell which of several fingerprints it is."""
    if radius % 2:
        raise ValueError("the radius has to be even: the two halves meet in the middle")
    masks = F.array(*[F.lit(m) for m in ball_masks(radius // 2, width)])
    meet = classes.select("rep", "fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "rep", "fp").repartition(parts(classes.sparkSession), "variant")
    w = Window.partitionBy("variant").orderBy("fp", "rep")
    chained = meet.select(F.lag("rep").over(w).alias("a"), F.col("rep").alias("b"), F.lag("fp").over(w).alias("fp_a"), F.col("fp").alias("fp_b"))
    return chained.filter(F.col("a").isNotNull()).distinct().filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius).select("a", "b")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id, fp (signed long), component (the smallest id that links reach, its own included).

    Ids are integers. Null and empty texts, and those of white space alone, have fingerprint zero and are linked like any
    other. Rows with a null id get the component of their fingerprint where another row gives it an id, else null.
    Repeated rows repeat in the result; an empty table gives an empty result; other columns play no part."""
    found = write_shared(fingerprints(df, id_col, text_col, width), "simhash")
    classes = write_shared(found.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    roots = connected_components(ball_links(classes.filter("rep IS NOT NULL"), radius))
    reps = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return found.join(reps, "fp").select("id", "fp", "component")


#: Similarity search: fingerprints of a text, their bits, and the bits that all of a candidate's may differ in together.
SIGNS, SIGN_BITS, FAR_BITS = 4, 32, 32
#: Counters of the frequency sketch, and parts that they are summed in.
SKETCH_BITS, SEGMENTS = 22, 64
#: Rows of an Arrow batch that a task hands over at a time.
SLICE = 200_000
#: Sizes of sets fall into bands of this ratio: similar sets are in the same band or neighbours.
BAND = 1.25
#: Words of a set's bitmap.
BITMAP = tuple(f"bits{k}" for k in range(8))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, exact; two empty sets: 0."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    found = np.zeros(0, np.uint64)
    for block in shingle_hashes(text, width):
        found = np.union1d(found, block)
    return found


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix(hashes: np.ndarray, ranks: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's hashes in the order of all sets: of two sets with a similarity of ``least``, the prefixes meet.

    They share at least ceil(least * n) of the n hashes of either, so not all of them can lie behind its first
    n - ceil(least * n) + 1. The order is free: rare hashes come first, by the ranks of their counters."""
    size = len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1
    return hashes[np.argsort(ranks[_counter(hashes)], kind="stable")][:size]


def shingle_ranks(texts: DataFrame, width: int) -> np.ndarray:
    """A rank from 0 to 255 for each counter of a sketch: how many texts hold shingles that fall to it, by steps of a logarithm.

    All texts count, in a fixed number of counters, so what tasks send and the driver gets (4 MB) does not grow. Shingles that share
    a counter share a rank; only speed depends on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            for t in b.column(0):
                np.add.at(sketch, _counter(shingle_set(t.as_py(), width)), 1)
        parts_ = [zstandard.compress(x.tobytes(), 1) if x.any() else None for x in sketch.reshape(SEGMENTS, -1)]
        some = [i for i, x in enumerate(parts_) if x]
        for lo in range(0, len(some), 8):
            yield pa.RecordBatch.from_arrays([pa.array(some[lo : lo + 8], pa.int32()), pa.array([parts_[i] for i in some[lo : lo + 8]], pa.binary())], ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(zstandard.decompress(counts), np.uint32)
                sums[segment] = sums.get(segment, 0) + x.astype(np.uint64)
        for segment, x in sums.items():
            ranks = np.minimum(255, np.round(8 * np.log2(1.0 + x))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["segment", "ranks"])

    sent = texts.select("text").mapInArrow(count, "segment int, counts binary").repartition(SEGMENTS, "segment")
    out = np.zeros((SEGMENTS, (1 << SKETCH_BITS) // SEGMENTS), np.uint8)
    for r in sent.mapInArrow(add, "segment int, ranks binary").collect():
        out[r["segment"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.ravel()


def _bitmaps(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles, BITMAP): the number of shingles and, for each of 512 bits, the parity of the number that fall to it. Two bitmaps differ in at most as many bits
    as there are shingles in one set and not in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, words = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, len(BITMAP)), np.int64)
            for row, t in enumerate(b.column(1)):
                found = shingle_set(t.as_py(), width)
                n[row] = len(found)
                odd = np.bincount((found & np.uint64(64 * len(BITMAP) - 1)).astype(np.int64), minlength=64 * len(BITMAP)) & 1
                words[row] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *(pa.array(words[:, k]) for k in range(len(BITMAP)))], ["id", "shingles", *BITMAP])

    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("shingles", *BITMAP)])
    return texts.join(ids, "id", "left_semi").mapInArrow(run, schema)


def _possible(texts: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' bitmaps do not rule out a similarity of ``least``."""
    marks = write_shared(_bitmaps(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width), "near-marks")
    left, right = (marks.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("shingles", *BITMAP))) for c in "ab")
    apart = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in BITMAP), F.lit(0))
    most = (1 - least) / (1 + least) * (F.col("shingles_a") + F.col("shingles_b")) + 1e-6
    return write_shared(pairs.join(right, "b").join(left, "a").filter(apart <= most).select("a", "b").distinct(), "near-possible")


def _verified(texts: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' complete shingle sets have a similarity of ``least`` or more. Sets are made for the texts in pairs only."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), width).tobytes() for t in b.column(1)], pa.binary())], ["id", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = texts.schema["id"].dataType
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    made = write_shared(texts.join(ids, "id", "left_semi").mapInArrow(sets, T.StructType([T.StructField("id", of), T.StructField("shingles", T.BinaryType())])), "near-sets")
    left, right = (made.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    # the set of a hub, "a", joins last: it is not repeated in an exchange
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")
    return write_shared(both.mapInArrow(verify, T.StructType([T.StructField(c, of) for c in "ab"])), "near-links")


def short_fingerprints(text: bytes | None, width: int = 3) -> np.ndarray:
    """SIGNS fingerprints of SIGN_BITS bits over the distinct shingles of a whole text, in 64-bit words; no words: empty.
    Each shingle's hash is hashed anew for every 64 bits."""
    found = shingle_set(text, width)
    ones = np.zeros((SIGNS * SIGN_BITS // 64, 64), np.int64)
    for at in range(0, len(found), BLOCK):
        for k, of in enumerate(ones):
            x = (found[at : at + BLOCK] ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            of += np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u8") if len(found) else np.zeros(0, np.uint64)


def fingerprint_pairs(texts: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of ids of texts of which one of the SIGNS fingerprints differs in at most ``radius`` bits, and all together in at
    most FAR_BITS: each with the smallest id of its fingerprint, and those ids by their balls. Texts without a word have no pairs."""
    signs = [f"sign{k}" for k in range(SIGNS * SIGN_BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [short_fingerprints(t.as_py()) for t in b.column(1)]
            some = [i for i, x in enumerate(made) if len(x)]
            rows = np.array([made[i] for i in some], np.uint64).reshape(-1, len(signs)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), *(pa.array(rows[:, k]) for k in range(len(signs)))], ["id", *signs])

    schema = T.StructType([texts.schema["id"]] + [T.StructField(c, T.LongType()) for c in signs])
    found = write_shared(texts.mapInArrow(run, schema), "near-fingerprints")
    # which fingerprint it is stands above its bits
    low = F.lit((1 << SIGN_BITS) - 1)
    each = [F.shiftrightunsigned(signs[at // 64], at % 64).bitwiseAND(low).bitwiseOR(F.lit(at // SIGN_BITS << SIGN_BITS)) for at in range(0, SIGNS * SIGN_BITS, SIGN_BITS)]
    members = found.select("id", F.explode(F.array(*each)).alias("fp"))
    classes = write_shared(members.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "near-classes")
    stars = members.join(classes.filter("n > 1"), "fp").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    met = stars.unionByName(ball_links(classes, radius, SIGN_BITS)).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (found.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in signs)) for c in "ab")
    apart = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in signs), F.lit(0))
    return write_shared(met.join(right, "b").join(left, "a").filter(apart <= FAR_BITS).select("a", "b").distinct(), "near-balls")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) that the links do not connect."""
    roots = connected_components(links)
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return pairs.join(left, "a", "left").join(right, "b", "left").filter("root_a IS NULL OR root_b IS NULL OR root_a <> root_b").select("a", "b")


def similar_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """Links (a, b) between ids, each verified on complete shingle sets, that connect all texts of a similarity of ``least`` or more.

    The first candidates are texts of which a fingerprint differs in at most ``radius`` bits. A similarity of ``least`` may mean more bits
    in each, so an exact search follows for texts that these links do not connect: similar sets meet in their prefixes
    (see ``prefix``), and at the first hash that they share, what is left of both suffices for the overlap. As rare shingles come
    first, what many texts share beside their own words comes too late for that, and such texts are no candidates. Of the texts that
    meet at a hash, each is first verified with a hub, the one with the fewest rarer shingles; then all pairs that the links so far
    have not joined yet are, unless bitmaps of their sets show that they differ in too much. So large groups of near copies cost one
    comparison a text.
    Rows with null ids or without a word have no links."""
    spark = df.sparkSession
    arrow_limits(spark)
    texts = df.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    near_fp = fingerprint_pairs(texts, radius)
    linked = _verified(texts, _possible(texts, near_fp, width, least), width, least)
    shipped = spark.sparkContext.broadcast(shingle_ranks(texts, width))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shipped.value
        for b in batches:
            found = [shingle_set(t.as_py(), width) for t in b.column(1)]
            keys = [prefix(s, ranks, least) if len(s) else s for s in found]
            n = [len(k) for k in keys]
            at = np.repeat(np.arange(len(n)), n)
            place = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64)
            flat = np.concatenate(keys).view(np.int64) if n else np.zeros(0, np.int64)
            size = np.array([len(s) for s in found], np.int64)[at]
            for lo in range(0, len(flat), SLICE):
                cut = slice(lo, lo + SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(flat[cut]), b.column(0).take(pa.array(at[cut])), pa.array(size[cut]), pa.array(place[cut])], ["key", "id", "size", "place"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", df.schema[id_col].dataType), T.StructField("size", T.LongType()), T.StructField("place", T.LongType())])
    w = Window.partitionBy("key").orderBy("id")
    keyed = texts.mapInArrow(first, schema).repartition(parts(spark), "key")
    near = keyed.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w)).filter("before IS NOT NULL OR after IS NOT NULL")
    met = write_shared(near.select("key", "id", "size", "place"), "near-prefixes")

    def fits(a: str, b: str) -> Column:
        """Sizes and places allow for the overlap that ``least`` asks for, if this is the first hash that the two share."""
        size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
        rest = F.least(size_a - F.col(f"{a}.place"), size_b - F.col(f"{b}.place"))
        return (F.least(size_a, size_b) >= least * F.greatest(size_a, size_b) - 1e-6) & (rest >= least / (1 + least) * (size_a + size_b) - 1e-6)

    # the hub of a key has the fewest shingles of its own before it: of copies of an original, the original or the one closest to it
    members = met.select("key", F.struct("place", "id", "size").alias("b"))
    hubs = members.withColumn("a", F.first("b").over(Window.partitionBy("key").orderBy("b")))
    starred = hubs.filter((F.col("a.id") != F.col("b.id")) & fits("a", "b")).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    stars = write_shared(_apart(starred.join(near_fp, ["a", "b"], "left_anti"), linked), "near-stars")
    links = linked.unionByName(_verified(texts, stars, width, least))
    roots = connected_components(links).select(F.col("node").alias("id"), "root")
    rooted = met.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    at_key = Window.partitionBy("key")
    mixed = rooted.withColumn("low", F.min("root").over(at_key)).withColumn("high", F.max("root").over(at_key)).filter("low <> high")
    mixed = write_shared(mixed.withColumn("main", F.first("root").over(at_key.orderBy("place", "id"))).select("key", "id", "size", "place", "root", "main"), "near-mixed")
    # one of a pair in different groups is not in the hub's group
    marks = write_shared(_bitmaps(texts, mixed.select("id").distinct(), width), "near-bitmaps")
    side = mixed.join(marks, "id").select("key", F.floor(F.log("size") / math.log(BAND)).cast("int").alias("band"), (F.col("root") == F.col("main")).alias("in_main"), F.struct("id", "size", "place", "root", *BITMAP).alias("a"))
    reach = side.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("in_main").alias("b_in_main"), F.col("a").alias("b"))
    once = F.col("b_in_main") | (F.col("a.id") < F.col("b.id"))
    apart = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in BITMAP), F.lit(0))
    most = (1 - least) / (1 + least) * (F.col("a.size") + F.col("b.size")) + 1e-6
    open_ = side.filter(~F.col("in_main")).join(reach, ["key", "band"]).filter(once & (F.col("a.root") != F.col("b.root")) & fits("a", "b") & (apart <= most))
    others = write_shared(open_.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct().join(stars.unionByName(near_fp), ["a", "b"], "left_anti"), "near-others")
    return links.unionByName(_verified(texts, others, width, least))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows whose id is the smallest of its group of near copies, with all their columns; groups are closed over links of
    ``least`` similarity on shingles of ``width`` words. Rows with null ids or without a word stay, repeated rows repeat."""
    gone = connected_components(similar_links(df, id_col, text_col, width=width, least=least)).filter("node <> root").select(F.col("node").alias("__gone"))
    return df.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def op3_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_components(docs).select(F.col("id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op3_simhash_balls": op3_simhash_balls}
