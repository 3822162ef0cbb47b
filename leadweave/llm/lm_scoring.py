"""Language-model scores by deleted interpolation of n-gram estimates.

    P(w | v) = a2(b) c(v w) / c(v)  +  a1(b) c(w) / N  +  a0(b) / (V + 1),   b = the frequency bucket of c(v)

Counts are of all training documents. The weights of a bucket are learned by expectation-maximisation on the counts of
held-out training documents, against estimates from the others.

Nothing of the corpus-wide tables is broadcast, and no text crosses the network. The work is in *blocks* of documents:

1. a scan task turns each block of texts into token numbers and the hashes of its own vocabulary (written once);
2. a block sends the distinct n-grams that it holds, with their counts, as sorted arrays of 64-bit hashes, one array for
   each range of hash values; the task of a range sums the counts of all blocks and answers each with the totals of
   just those n-grams, in the order in which they came;
3. a block and its answers meet, and every text is scored from arrays.

So traffic and memory follow the distinct n-grams of a block, a frequent word costs no more than a rare one, and a range is
a slice of uniform hashes whatever the corpus looks like.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, crc_mod, parts, table, write_shared

#: Bytes of text of a block, at most (a single longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Bytes of packed n-grams of a range, about.
RANGE_BYTES = 16 << 20
#: Remainders of crc32(id) mod 7: never trained on; trained on, but held out while the weights are learned.
TEST, TUNE, FOLDS = 2, 3, 7
BUCKETS = 24
#: Steps of the logarithmic grid on which held-out counts are gathered, per doubling, and its reach in doublings.
GRID, REACH = 4, 44
ROUNDS = 60
#: Tokens of no text: they hold white space.
END, START = b" end", b" start"


def _pack(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), dtype) if data else np.zeros(0, dtype)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys: differences, their bytes by significance, so that the empty high ones compress away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _pack(steps.view(np.uint8).reshape(-1, 8).T)


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = _unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + right
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else 1 + floor(log2(count)), BUCKETS - 1 at most."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


class Block:
    """Documents as token numbers of the block's own vocabulary; number 0 is the end, 1 the start."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.vocabulary[END], self.vocabulary[START]
        self.tokens: list[np.ndarray] = []
        self.ids, self.folds, self.bytes = [], [], 0

    def add(self, i, fold: int, text: bytes | None) -> None:
        words = (text or b"").lower().split()
        self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, [*words, END]), np.uint32, len(words) + 1))
        self.ids.append(i)
        self.folds.append(fold)
        self.bytes += len(text or b"") + 16

    def record(self, number: int) -> dict:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        return {"block": number, "tokens": _pack(np.concatenate(self.tokens)), "vocabulary": hashes.tobytes(), "lengths": _pack(np.array([len(t) for t in self.tokens], np.uint32)), "ids": self.ids, "folds": self.folds}


def _blocks(block_bytes: int, schema: pa.Schema):
    """Step 1. Documents held out for the weights go into blocks of their own, so that these can be read alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, open_ = TaskContext.get().partitionId() << 30, 0, {}

        def close(tune: bool):
            nonlocal n
            row = open_.pop(tune).record(base + n) | {"tune": tune}
            n += 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for i, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                blk = open_.setdefault(fold == TUNE, Block())
                blk.add(i, fold, text.as_py())
                if blk.bytes >= block_bytes:
                    yield close(fold == TUNE)
        for tune in list(open_):
            yield close(tune)

    return run


class Grams:
    """The distinct tokens and pairs of a block, ordered by hash, and where each token of its texts is among them."""

    def __init__(self, tokens: np.ndarray, vocabulary: np.ndarray, lengths: np.ndarray):
        self.tokens = tokens.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]])
        self.before = np.concatenate([[1], self.tokens[:-1]])
        self.before[first] = 1
        pairs, self.pair_of = np.unique(self.before * len(vocabulary) + self.tokens, return_inverse=True)
        keys = pair_hash(vocabulary[pairs // len(vocabulary)], vocabulary[pairs % len(vocabulary)])
        self.unigrams, self.bigrams = (np.argsort(k, kind="stable") for k in (vocabulary, keys))
        self.keys = vocabulary[self.unigrams], keys[self.bigrams]

    def counts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted occurrences of the n-grams, in the order of ``keys``."""
        uni = np.bincount(self.tokens, weights, len(self.unigrams))[self.unigrams]
        return uni.astype(np.int64), np.bincount(self.pair_of, weights, len(self.bigrams))[self.bigrams].astype(np.int64)


def _grams_of(row: dict) -> tuple[Grams, np.ndarray, np.ndarray]:
    lengths = _unpack(row["lengths"], np.uint32)
    folds = np.array(row["folds"], np.int64)
    return Grams(_unpack(row["tokens"], np.uint32), np.frombuffer(row["vocabulary"], np.uint64), lengths), lengths, folds


def _send(ranges: int):
    """Step 2, a block's part: its n-grams and their counts by ranges of the hash."""
    bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                grams, lengths, folds = _grams_of(row)
                weight = np.repeat(folds != TEST, lengths).astype(np.float64)
                for kind, (keys, n) in enumerate(zip(grams.keys, grams.counts(weight)), 1):
                    cut = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
                    out = [(r, row["block"], kind, row["tune"], _pack_keys(keys[lo:hi]), _pack(n[lo:hi].astype(np.uint32))) for r, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]
                    for lo in range(0, len(out), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 64]), (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["range", "block", "kind", "tune", "keys", "n"])

    return run


_SENT = "range int, block long, kind int, tune boolean, keys binary, n binary"
_ANSWER = "block long, range int, kind int, tune boolean, total binary, held binary, seen long, sum_total long, sum_held long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, a range's part: rows sorted by (range, kind); totals over all blocks, back to each block.

    ``total`` counts all training documents, ``held`` those held out for the weights. A last row per range and kind, for
    block -1, has the number of different n-grams in training and the sums of both."""
    at, asked = None, []

    def reply():
        keys, where = np.unique(np.concatenate([k for _, _, k, _ in asked]), return_inverse=True)
        n = np.concatenate([c for _, _, _, c in asked]).astype(np.float64)
        held = np.concatenate([np.full(len(k), t) for _, t, k, _ in asked])
        total, held = np.bincount(where, n, len(keys)).astype(np.int64), np.bincount(where, n * held, len(keys)).astype(np.int64)
        lo = 0
        names = [f.split()[0] for f in _ANSWER.split(", ")]
        for block, tune, k, _ in asked:
            mine = where[lo : lo + len(k)]
            lo += len(k)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (block, at[0], at[1], tune, _pack(total[mine]), _pack(held[mine]) if tune else b"", 0, 0, 0)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (-1, at[0], at[1], False, b"", b"", int((total > 0).sum()), int(total.sum(dtype=np.int64)), int(held.sum(dtype=np.int64)))], names)

    schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("kind", pa.int32()), ("tune", pa.bool_()), ("total", pa.binary()), ("held", pa.binary()), ("seen", pa.int64()), ("sum_total", pa.int64()), ("sum_held", pa.int64())])

    def typed(bs):
        for x in bs:
            yield x.cast(schema)

    for b in batches:
        for r, block, kind, tune, keys, n in zip(*(c.to_pylist() for c in b.columns)):
            if (r, kind) != at:
                if asked:
                    yield from typed(reply())
                at, asked = (r, kind), []
            asked.append((block, tune, _unpack_keys(keys), _unpack(n, np.uint32)))
    if asked:
        yield from typed(reply())


def _meet(blocks: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """Step 3's input: each block's answers in order, then the block."""
    binary, none = F.lit(None).cast("binary"), F.lit(None)
    ids = blocks.schema["ids"].dataType
    left = answers.select("block", "kind", "range", F.col("total").alias("tokens"), F.col("held").alias("vocabulary"), binary.alias("lengths"), none.cast(ids).alias("ids"), none.cast("array<int>").alias("folds"))
    right = blocks.select("block", F.lit(3).alias("kind"), F.lit(0).alias("range"), "tokens", "vocabulary", "lengths", "ids", "folds")
    return left.unionByName(right).repartition(n, "block").sortWithinPartitions("block", "kind", "range")


def _met(batches: Iterator[pa.RecordBatch]):
    """(block's row, its grams, lengths, folds, {kind: (totals, held)}) for each block of a task."""
    got: dict[int, list] = {1: [], 2: []}
    for b in batches:
        for row in b.to_pylist():
            if row["kind"] < 3:
                got[row["kind"]].append((_unpack(row["tokens"], np.int64), _unpack(row["vocabulary"], np.int64)))
                continue
            counts = {k: tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*v)) for k, v in got.items()}
            yield row, *_grams_of(row), counts
            got = {1: [], 2: []}


def _by_token(grams: Grams, uni: np.ndarray, bi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(v) and c(v w) at each token. A start is followed as often as there are ends."""
    of_token = np.zeros(len(uni), np.int64)
    of_token[grams.unigrams] = uni
    of_pair = np.zeros(len(bi), np.int64)
    of_pair[grams.bigrams] = bi
    of_token[1] = of_token[0]
    return of_token[grams.tokens], of_token[grams.before], of_pair[grams.pair_of]


def _held_out(n_train: int, n_types: int):
    """Held-out counts on a grid: (bucket, step of p2 / p0, step of p1 / p0) with the number of tokens there."""

    def step(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(x > 0, np.clip(np.round(np.log2(x) * GRID) + GRID * REACH / 4, 1, GRID * REACH - 1), 0).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BUCKETS * (GRID * REACH) ** 2, np.int64)
        for _, grams, _, _, counts in _met(batches):
            left = [counts[k][0].astype(np.int64) - counts[k][1] for k in (1, 2)]
            c_w, c_v, c_vw = _by_token(grams, *left)
            p2 = np.divide(c_vw, c_v, out=np.zeros(len(c_v)), where=c_v > 0) * (n_types + 1)
            p1 = c_w / max(1, n_train) * (n_types + 1)
            np.add.at(cells, (bucket(c_v) * GRID * REACH + step(p2)) * GRID * REACH + step(p1), 1)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])

    return run


def weights(cells: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Expectation-maximisation: (bucket, order 2, 1, 0) from held-out counts on the grid.

    Each order gets one pseudo-count a bucket; buckets without held-out tokens take the weights of all together. Contexts
    never seen have no pairs, so bucket 0 has no weight on them."""
    side = GRID * REACH

    def ratio(step: np.ndarray) -> np.ndarray:
        return np.where(step > 0, np.exp2((step - side / 4) / GRID), 0.0)

    b, x = cells // side**2, np.stack([ratio(cells // side % side), ratio(cells % side), np.ones(len(cells))], axis=1)

    def learn(x: np.ndarray, n: np.ndarray, use: np.ndarray) -> np.ndarray:
        w = use / use.sum()
        for _ in range(rounds):
            share = x * w
            share *= (n / share.sum(axis=1))[:, None]
            w = (share.sum(axis=0) + use) / (n.sum() + use.sum())
        return w

    out = np.zeros((BUCKETS, 3))
    pooled = learn(x, n, np.ones(3)) if len(n) else np.full(3, 1 / 3)
    for k in range(BUCKETS):
        use = np.array([float(k > 0), 1.0, 1.0])
        mine = b == k
        out[k] = learn(x[mine], n[mine], use) if mine.any() else pooled * use / (pooled * use).sum()
    return out


def _score(alpha: np.ndarray, n_train: int, n_types: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, grams, lengths, folds, counts in _met(batches):
            c_w, c_v, c_vw = _by_token(grams, counts[1][0], counts[2][0])
            a = alpha[bucket(c_v)]
            p = a[:, 0] * np.divide(c_vw, c_v, out=np.zeros(len(c_v)), where=c_v > 0) + a[:, 1] * c_w / max(1, n_train) + a[:, 2] / (n_types + 1)
            base = np.log10((c_w + 1) / (n_train + n_types + 1))
            first = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]])
            sums = [np.add.reduceat(x, first) for x in ((c_w > 0).astype(np.int64), base, np.log10(p))]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], schema.field("id").type), pa.array(folds == TEST), pa.array(lengths.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(lengths), n_train)), pa.array(sums[1]), pa.array(sums[2])], schema=schema)

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of probabilities).

    Null text is an empty document: one token, the end. A null id counts as the empty text for the fold. Repeated rows are
    as many documents. Without training documents every token is unknown: both scores are of the uniform model over
    one type. An empty table gives an empty result; other columns play no part. n-grams are told apart by 64 bits of
    hash."""
    spark = df.sparkSession
    arrow_limits(spark)
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(f"`{id_col}`").alias("id"), crc_mod(F.col(f"`{id_col}`"), FOLDS).cast("int").alias("fold"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    probe = docs.select("id").limit(0).toArrow().schema.field("id").type
    names = [("block", pa.int64()), ("tokens", pa.binary()), ("vocabulary", pa.binary()), ("lengths", pa.binary()), ("ids", pa.list_(probe)), ("folds", pa.list_(pa.int32())), ("tune", pa.bool_())]
    fields = [T.StructField("block", T.LongType())] + [T.StructField(c, T.BinaryType()) for c in ("tokens", "vocabulary", "lengths")] + [T.StructField("ids", T.ArrayType(id_type)), T.StructField("folds", T.ArrayType(T.IntegerType())), T.StructField("tune", T.BooleanType())]
    blocks = write_shared(docs.mapInArrow(_blocks(block_bytes, pa.schema(names)), T.StructType(fields)), "lm-blocks")
    # a task holds one range of one kind: ranges follow the blocks, each of which sends about its own bytes
    ranges = max(2 * parts(spark), math.ceil(blocks.count() * block_bytes / RANGE_BYTES))
    sent = blocks.mapInArrow(_send(ranges), _SENT)
    answers = write_shared(sent.repartitionById(ranges, "range").sortWithinPartitions("range", "kind").mapInArrow(_answer, _ANSWER), "lm-answers")
    sums = {r["kind"]: r for r in answers.filter("block = -1").groupBy("kind").agg(F.sum("seen").alias("seen"), F.sum("sum_total").alias("total"), F.sum("sum_held").alias("held")).collect()}
    # the start is no token: no text holds it, so its own count is zero and it is not among the types
    n_types, n_train, n_held = (sums[1]["seen"], sums[1]["total"], sums[1]["held"]) if 1 in sums else (0, 0, 0)
    replies = answers.filter("block >= 0")
    tuned = _meet(blocks.filter("tune"), replies.filter("tune"), ranges).mapInArrow(_held_out(n_train - n_held, n_types), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    alpha = weights(np.array([r["cell"] for r in tuned], np.int64), np.array([r["n"] for r in tuned], np.float64))
    out = pa.schema([("id", probe), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])
    return _meet(blocks, replies, ranges).mapInArrow(_score(alpha, n_train, n_types, out), schema)


def op10_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_deleted_interpolation": op10_deleted_interpolation}
