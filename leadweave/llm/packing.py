"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut). Pieces are dealt at random into
shards of bounded size, and every shard is packed by several *islands*, each a task of its own with its own population.
A chromosome is a list of bins. Crossover injects whole well-filled bins of one parent into the other, removes the bins
that hold a piece twice, and puts displaced pieces back by best fit, largest first; mutation empties poor bins. The first
chromosomes place pieces in random order, so that the search finds its bins by crossover. After an
epoch each island's elite migrates to the next island of the ring and joins its population. The best island of a shard
wins. The poorly filled bins of all shards are then dealt out and packed together once more, so that shards do not each
end with a part-filled bin.

Nothing is gathered but (piece, length) pairs, at most a shard's worth in a task.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, table, write_shared
from leadweave.llm.word_tokens import word_tokenizer

CAPACITY = 4096
END_ID = 1
#: Pieces of a shard on average, islands of a shard, epochs between migrations, and each island's effort.
SHARD = 8192
ISLANDS = 2
EPOCHS = 2
POPULATION = 3
OFFSPRING = 8
#: Share of the bins with room that a mutation empties.
MUTATED = 0.3
#: Bins filled less than this go into the second packing.
POOR = 0.97


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document; null text counts as empty, a document ends with END_ID."""
    arrow_limits(df.sparkSession)
    path = vocabulary or word_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = word_tokenizer(path), END_ID.to_bytes(4, "little")
        for b in batches:
            at, out = [], ([], [], [], [])
            for row, text in enumerate(b.column(1)):
                ids = tok.ids(text.as_py()) + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    at.append(row)
                    size = min(capacity, n - start)
                    for col, v in zip(out, (k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(c, pa.int64()) for c in out[1:]]], ["id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, schema)


class Bins:
    """Bins under construction, found by the room left: a bit set over the rooms gives the best fit in one step."""

    def __init__(self, lengths: list[int], capacity: int, bins: list[list[int]] = (), fill: list[int] | None = None):
        self.lengths, self.capacity = lengths, capacity
        self.bins = list(map(list, bins))
        self.fill = [sum(map(lengths.__getitem__, b)) for b in self.bins] if fill is None else fill
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0
        for i, f in enumerate(self.fill):
            self._open(i, capacity - f)

    def _open(self, i: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(i)
        self.rooms |= 1 << room

    def best_fit(self, items: Iterable[int]) -> None:
        """Place items, largest first, each into the bin that it leaves fullest."""
        lengths = self.lengths
        for x in sorted(items, key=lengths.__getitem__, reverse=True):
            self.place(x)

    def place(self, x: int) -> None:
        size = self.lengths[x]
        if fits := self.rooms >> size:
            room = size + (fits & -fits).bit_length() - 1
            same = self.by_room[room]
            i = same.pop()
            if not same:
                self.rooms ^= 1 << room
        else:
            i, room = len(self.bins), self.capacity
            self.bins.append([])
            self.fill.append(0)
        self.bins[i].append(x)
        self.fill[i] += size
        if room > size:
            self._open(i, room - size)


def fitness(c: Bins) -> tuple[int, float]:
    """Smaller is better: number of bins, then unevenness of their fill (full bins and one poor one beat many half-full)."""
    return len(c.bins), -sum(f * f for f in c.fill) / c.capacity**2


def scattered(lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """A chromosome to start from: every item into the bin that it leaves fullest, in random order."""
    out = Bins(lengths, capacity)
    for x in rng.sample(range(len(lengths)), len(lengths)):
        out.place(x)
    return out


def descending(lengths: list[int], capacity: int) -> Bins:
    """Best fit decreasing, the yardstick of the search."""
    out = Bins(lengths, capacity)
    out.best_fit(range(len(lengths)))
    return out


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``b`` into ``a``; bins of ``a`` that share an item with them are dissolved, the rest refitted."""
    floor = a.capacity * rng.uniform(0.985, 1.0)
    chosen = [i for i, f in enumerate(b.fill) if f >= floor and rng.random() < 0.5]
    taken = {x for i in chosen for x in b.bins[i]}
    kept, fill, displaced = [b.bins[i] for i in chosen], [b.fill[i] for i in chosen], []
    for x, f in zip(a.bins, a.fill):
        if taken.isdisjoint(x):
            kept.append(x)
            fill.append(f)
        else:
            displaced += [i for i in x if i not in taken]
    out = Bins(a.lengths, a.capacity, kept, fill)
    out.best_fit(displaced)
    return out


def mutate(c: Bins, rng: random.Random) -> Bins:
    """Empty the poorest bins, some others that are not full and a few that may be, and refit what they held."""
    n = max(1, len(c.bins) // 50)
    part = sorted((i for i, f in enumerate(c.fill) if f < c.capacity), key=c.fill.__getitem__)
    gone = {*part[:n], *(i for i in part if rng.random() < MUTATED), *rng.sample(range(len(c.bins)), min(len(c.bins), n))}
    kept = [i for i in range(len(c.bins)) if i not in gone]
    out = Bins(c.lengths, c.capacity, [c.bins[i] for i in kept], [c.fill[i] for i in kept])
    out.best_fit([x for i in gone for x in c.bins[i]])
    return out


def evolve(lengths: list[int], capacity: int, elites: list[list[list[int]]], seed: int, *, population: int = POPULATION, offspring: int = OFFSPRING, counts: dict[str, int] | None = None) -> Bins:
    """One epoch of one island; returns its elite. Ends early at the bound below which no packing can go.

    No chromosome starts from the descending order: the search has to find its bins. It is best fit decreasing that is
    returned only where the search ends above the bound and with more bins than that. ``counts`` gets the number of crossovers
    and 1 as ``fallback`` in that case."""
    rng = random.Random(seed)
    counts = {} if counts is None else counts
    least = max(math.ceil(sum(lengths) / capacity), sum(2 * x > capacity for x in lengths))
    pool = [Bins(lengths, capacity, e) for e in elites if e]
    while len(pool) < population and not any(len(c.bins) <= least for c in pool):
        pool.append(scattered(lengths, capacity, rng))
    scored = sorted(((fitness(c), c) for c in pool), key=lambda s: s[0])[:population]
    counts["crossovers"] = counts["fallback"] = 0
    for _ in range(offspring):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        (_, a), (_, b) = rng.sample(scored, 2)
        child = mutate(crossover(a, b, rng), rng)
        counts["crossovers"] += 1
        scored = sorted([*scored, (fitness(child), child)], key=lambda s: s[0])[:population]
    if scored[0][0][0] > least:
        plain = descending(lengths, capacity)
        if len(plain.bins) < scored[0][0][0]:
            counts["fallback"] = 1
            return plain
    return scored[0][1]


_ISLAND = "shard long, island int, source int, rid long, length long, bin int"


def _epoch(capacity: int, epoch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        own = pdf[pdf["source"] == 0].sort_values("rid")
        at = {r: i for i, r in enumerate(own["rid"].tolist())}
        elites = []
        for _, part in pdf[pdf["bin"] >= 0].groupby("source"):
            bins: dict[int, list[int]] = {}
            for r, b in zip(part["rid"].tolist(), part["bin"].tolist()):
                bins.setdefault(b, []).append(at[r])
            elites.append(list(bins.values()))
        best = evolve(own["length"].tolist(), capacity, elites, hash((shard, island, epoch)))
        where = [0] * len(at)
        for k, b in enumerate(best.bins):
            for x in b:
                where[x] = k
        return own.assign(bin=where)[["shard", "island", "source", "rid", "length", "bin"]]

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Items (rid, length) with length <= capacity to (shard, rid, length, bin), by the best island of each shard."""
    n = items.count()
    shards = max(1, round(n / shard))
    dealt = items.select(F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"), "rid", "length")
    state = dealt.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(0).alias("source"), "rid", "length", F.lit(-1).alias("bin"))
    for epoch in range(epochs):
        evolved = write_shared(state.groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), _ISLAND), f"packing-epoch{epoch}")
        migrants = evolved.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))).withColumn("source", F.lit(1))
        state = evolved.unionByName(migrants)
    fill = evolved.groupBy("shard", "island", "bin").agg(F.sum("length").alias("fill"))
    score = fill.groupBy("shard", "island").agg(F.count("*").alias("bins"), F.sum(F.pow(F.col("fill") / capacity, 2)).alias("even"))
    best = score.groupBy("shard").agg(F.min_by("island", F.struct("bins", -F.col("even"), "island")).alias("island"))
    return evolved.join(best, ["shard", "island"]).select("shard", "rid", "length", "bin")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is an empty document of one token, the end id. Repeated rows are packed as often as they come; null ids
    stay null. Pieces of exactly the capacity are sequences of their own. An empty table gives an empty result; other
    columns play no part."""
    cut = write_shared(pieces(df, id_col, text_col, vocabulary=vocabulary, capacity=capacity).withColumn("rid", F.monotonically_increasing_id()), "packing-pieces")
    options = {"capacity": capacity, "shard": shard, "islands": islands, "epochs": epochs}
    first = write_shared(pack(cut.filter(F.col("length") < capacity).select("rid", "length"), **options), "packing-first")
    fills = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    good = first.join(fills.filter(F.col("fill") >= POOR * capacity), ["shard", "bin"])
    poor = write_shared(first.join(fills.filter(F.col("fill") < POOR * capacity), ["shard", "bin"]).select("rid", "length"), "packing-poor")
    second = pack(poor, **options)
    # a sequence's number: its round in the lowest bit, above it bin and shard; lone full pieces have negative ones
    numbered = good.select("rid", "length", (F.shiftleft("shard", 24) + F.shiftleft(F.col("bin").cast("long"), 1)).alias("sequence_id")).unionByName(second.select("rid", "length", (F.shiftleft("shard", 24) + F.shiftleft(F.col("bin").cast("long"), 1) + 1).alias("sequence_id")))
    before = Window.partitionBy("sequence_id").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.select("rid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    packed = cut.filter(F.col("length") < capacity).join(placed, "rid")
    full = cut.filter(F.col("length") == capacity).select("*", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).drop("rid")


def op4_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_genetic_packing": op4_genetic_packing}
