"""Byte-level BPE encoding and decoding on segment trees.

A piece's live tokens are marked at their first byte. A segment tree over the byte positions holds, for each position,
the rank of the pair that starts there with the position below it, so that its root is the leftmost pair of minimum
rank. A merge replaces that pair, unlinks the right token, and does three point updates, each logarithmic in the piece's
bytes: the merged pair, the pair before it, and the position that is no longer live.

Pieces of up to BATCH_WIDTH bytes are merged side by side, a row of one array each; longer ones alone, in the same tree.
So a run of a hundred thousand letters takes n log n steps, and nothing is cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, table, worker_cache

#: Bytes of the longest piece that is merged in a batch, and cells of a batch's trees.
BATCH_WIDTH = 256
BATCH_CELLS = 1 << 19
#: Pieces kept by a worker: two generations of this many.
CACHE_PIECES = 200_000
CACHE_CHARS = 48
_NONE = np.iinfo(np.int64).max


def byte_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class PairTable:
    """(left id, right id) to the rank of their merge, in an open-addressing table that whole arrays probe at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            self.values[at[free]] = values[free]
            lost = self.keys[at] != keys
            keys, values, at = keys[lost], values[lost], at[lost] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where they do not merge."""
        keys = left << 32 | right
        out = np.full(len(keys), _NONE, np.int64)
        at = self._home(keys)
        seen = self.keys[at]
        hit = seen == keys
        out[hit] = self.values[at[hit]]
        rest = np.flatnonzero(~hit & (seen != -1))
        while len(rest):
            at[rest] = at[rest] + 1 & (1 << self.bits) - 1
            seen = self.keys[at[rest]]
            hit = seen == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (seen != -1)]
        return out


class BytePairs:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token_bytes = {i: t for t, i in ranks.items()}

    def encode_pieces(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(p) > BATCH_WIDTH:
                out[i] = b"".join([x.to_bytes(4, "little") for x in self._merge_one(p)])
            elif p:
                widths.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
        for width, rows in widths.items():
            step = max(1, BATCH_CELLS // width)
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                for i, ids in zip(some, self._merge_rows([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Merge pieces of at most ``width`` bytes (a power of two), a row each."""
        n, levels = len(pieces), width.bit_length() - 1
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        live = np.arange(width) < sizes[:, None]
        tok = np.zeros((n, width), np.int64)
        tok[live] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        pair = live[:, 1:]
        rank = self.table.rank(tok[:, :-1][pair], tok[:, 1:][pair])
        place = np.broadcast_to(np.arange(width - 1), pair.shape)[pair]
        leaves = tree[:, width : 2 * width - 1]
        leaves[pair] = np.where(rank == _NONE, _NONE, rank * width + place)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.minimum(np.arange(1, width + 1), sizes[:, None]).astype(np.int64)
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).astype(np.int64)
        tok, tree, after, before, alive = tok.ravel(), tree.ravel(), after.ravel(), before.ravel(), live.ravel()
        rows = np.arange(n)

        def update(cells: np.ndarray, root: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[root + node] = value
            for _ in range(levels):
                node = node >> 1
                both = root + 2 * node
                tree[root + node] = np.minimum(tree[both], tree[both + 1])

        while True:
            best = tree[rows * (2 * width) + 1]
            rows, best = rows[best != _NONE], best[best != _NONE]
            if not len(rows):
                break
            cell, root, at, merged = rows * width, rows * (2 * width), best & width - 1, best >> levels
            right = after[cell + at]
            tok[cell + at] = merged
            alive[cell + right] = False
            nxt = after[cell + right]
            after[cell + at] = nxt
            has = nxt < sizes[rows]
            before[(cell + nxt)[has]] = at[has]
            update(cell, root, right, np.full(len(rows), _NONE, np.int64))
            value = np.full(len(rows), _NONE, np.int64)
            r = self.table.rank(merged[has], tok[(cell + nxt)[has]])
            value[has] = np.where(r == _NONE, _NONE, r * width + at[has])
            update(cell, root, at, value)
            prev = before[cell + at]
            has = prev >= 0
            prev, sub = prev[has], cell[has]
            r = self.table.rank(tok[sub + prev], merged[has])
            update(sub, root[has], prev, np.where(r == _NONE, _NONE, r * width + prev))
        ids = tok[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.reshape(n, width).sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_one(self, piece: bytes) -> list[int]:
        """The same for one long piece."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        get, none = self.table.pairs.get, int(_NONE)
        tok: list[int | None] = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        key = lambda a, b, at: none if (r := get(tok[a] << 32 | tok[b])) is None else r * width + at
        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = key(i, i + 1, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        while (best := tree[1]) != none:
            at, merged = best % width, best // width
            right = after[at]
            nxt = after[right]
            tok[at], tok[right], after[at] = merged, None, nxt
            update(right, none)
            if nxt < n:
                before[nxt] = at
                update(at, key(at, nxt, at))
            else:
                update(at, none)
            if (prev := before[at]) >= 0:
                update(prev, key(prev, at, prev))
        return [t for t in tok if t is not None]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class TextEncoder:
    """Whole texts: each match of a pattern is encoded separately; pieces met lately are remembered."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = BytePairs(ranks)
        self.split = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        split = [self.split(t) for t in texts]
        unknown: set[str] = set()
        for pieces in split:
            unknown.update(pieces)
        unknown.difference_update(self.young)
        ask = []
        for p in unknown:
            if (ids := self.old.get(p)) is not None:
                self.young[p] = ids
            else:
                ask.append(p)
        extra = {}
        for p, ids in zip(ask, self.pairs.encode_pieces([p.encode() for p in ask])):
            (self.young if len(p) <= CACHE_CHARS else extra)[p] = ids
        if extra:
            return [b"".join([extra[p] if p in extra else self.young[p] for p in pieces]) for pieces in split]
        return [b"".join(map(self.young.__getitem__, pieces)) for pieces in split]


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process, kept between tasks."""
    return worker_cache(("bytes", path, pattern), lambda: TextEncoder(path, pattern))


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, and ids (little-endian unsigned 32-bit) with decoded, the bytes that they stand
    for; or, with ``digests``, ids_sha256 and decoded_sha256 in their place.

    Null text counts as empty and has no tokens. Special tokens are ordinary text. Repeated rows repeat, null ids stay
    null, an empty table gives an empty result; other columns play no part."""
    import public_tokenizers

    arrow_limits(df.sparkSession)
    path, pattern = ranks or byte_ranks(), pattern or public_tokenizers.PATTERN
    kind, arrow = (T.StringType(), pa.string()) if digests else (T.BinaryType(), pa.binary())
    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                out = [sha(x) for x in ids], [sha(enc.pairs.decode(x)) for x in ids]
            else:
                out = ids, [enc.pairs.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), n, *(pa.array(c, arrow) for c in out)], ["id", "n_tokens", *names])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, kind) for c in names)])
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def op7_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_segment_tree_bpe": op7_segment_tree_bpe}
