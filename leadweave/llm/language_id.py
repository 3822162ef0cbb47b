"""Language identification by interpolated Kneser-Ney character models.

One model per language predicts each letter of a word from up to ORDER - 1 characters before it, the word's start
included; words are the runs of letters of a text. Highest-order n-grams (and those that begin a word) carry their
counts, lower ones the number of different characters that precede them; every order is discounted and interpolated
with the next. Log-probabilities and back-off weights of all languages stand side by side in two sorted arrays of n-gram
hashes, so scoring is binary search over arrays.

A text gets the language of lowest cross-entropy per character. It is rejected where even that is far above what texts of
the language have, as calibrated on labelled texts that no count has seen.

Training takes a bounded sample of labelled rows: TRAIN_CHARS per language, in expectation. The model's size is bounded by
the sample, whatever the size of the corpus, and so is what is collected and broadcast.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, crc_mod, table, worker_cache

ORDER = 5
#: Characters of labelled text per language that counts are taken from, and share of the sampled rows kept for calibration.
TRAIN_CHARS = 1_500_000
CALIBRATION = 0.15
#: Standard deviations above the language's own cross-entropy from which a text is rejected, at least.
REJECT_Z = 6.0
#: Size of the alphabet that unseen characters are drawn from.
ALPHABET = 4096
UND = "und"
START, END = "\x02", "\x03"
#: Tokens kept by a worker, at most, before it starts anew.
CACHE_TOKENS = 300_000
#: Tokens looked up at a time.
BATCH_TOKENS = 200_000


def letter_runs(token: bytes) -> list[str]:
    """Runs of letters of a chunk of UTF-8, lower-cased."""
    w = token.decode("utf-8", "replace").lower()
    return [w] if w.isalpha() else "".join([c if c.isalpha() else " " for c in w]).split()


def word_grams(word: str, order: int = ORDER) -> list[str]:
    """The longest n-gram that ends at each character of the word and at its end."""
    w = START + word + END
    return [w[max(0, i - order + 1) : i + 1] for i in range(1, len(w))]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def end_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order: hash of the k characters that end at each position (positions too near the start are void)."""
    step = points.astype(np.uint64) + np.uint64(1)
    out = [np.zeros(len(points), np.uint64)]
    for k in range(1, order + 1):
        h = np.zeros(len(points), np.uint64)
        for back in range(k - 1, -1, -1):
            h[back:] = h[back:] * np.uint64(0x9E3779B97F4A7C15) + step[: max(0, len(step) - back)]
        out.append(_mix(h))
    return out


def gram_hash(grams: list[str]) -> np.ndarray:
    """The same hash, of whole strings."""
    out = np.zeros(len(grams), np.uint64)
    for k, rows in _by(grams, len).items():
        if k:
            points = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le"), np.uint32)
            out[rows] = end_hashes(points, k)[k][k - 1 :: k]
    return out


def _by(items, key) -> dict:
    out = defaultdict(list)
    for i, x in enumerate(items):
        out[key(x)].append(i)
    return out


def kneser_ney(top: dict[str, int], order: int = ORDER) -> tuple[dict[str, float], dict[str, float]]:
    """Counts of longest n-grams to log2 probabilities of n-grams and log2 back-off weights of contexts ('' among them)."""
    counts: list[dict[str, int]] = [defaultdict(int) for _ in range(order + 1)]
    for g, c in top.items():
        counts[len(g)][g] += c
    for k in range(order, 1, -1):
        for g in counts[k]:
            counts[k - 1][g[1:]] += 1
    prob: dict[str, float] = {}
    back: dict[str, float] = {}
    for k in range(1, order + 1):
        have = Counter(counts[k].values())
        n1, n2 = have[1], have[2]
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, types = defaultdict(int), defaultdict(int)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            types[g[:-1]] += 1
        for ctx in total:
            back[ctx] = discount * types[ctx] / total[ctx]
        for g, c in counts[k].items():
            lower = prob.get(g[1:], back.get("", 1.0) / ALPHABET) if k > 1 else 1 / ALPHABET
            prob[g] = max(c - discount, 0) / total[g[:-1]] + back[g[:-1]] * lower
    return {g: math.log2(p) for g, p in prob.items()}, {c: math.log2(b) for c, b in back.items()}


class CharModels:
    """Models of several languages in sorted hash arrays."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.langs, self.order = sorted(counts), order
        built = [kneser_ney(counts[x], order) for x in self.langs]
        self.grams, self.prob = self._sorted([p for p, _ in built], np.nan)
        self.contexts, self.back = self._sorted([b for _, b in built], 0.0)
        self.reject: np.ndarray | None = None  # per language: mean, spread between texts, spread within, limit of z

    def _sorted(self, tables: list[dict[str, float]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        names = sorted(set().union(*tables)) if tables else []
        hashes = gram_hash(names)
        order = np.argsort(hashes)
        values = np.array([[t.get(g, missing) for t in tables] for g in names], np.float32).reshape(len(names), len(tables))
        return hashes[order], values[order]

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of keys in a sorted table, -1 where absent."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def score_tokens(self, tokens: list[bytes]) -> np.ndarray:
        """(token, language + 1): log2 probability in each language, and number of characters that it sums over."""
        runs = [letter_runs(t) for t in tokens]
        text = "".join(START + r + END for rs in runs for r in rs)
        out = np.zeros((len(tokens), len(self.langs) + 1), np.float32)
        if not text:
            return out
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        hashes = end_hashes(points, self.order)
        starts = points == ord(START)
        place = np.arange(len(points))
        depth = place - np.maximum.accumulate(np.where(starts, place, 0))  # characters since the word's start
        event = np.flatnonzero(~starts)
        avail = np.minimum(depth[event], self.order - 1)
        value = np.zeros((len(event), len(self.langs)), np.float32)
        open_ = np.ones(value.shape, bool)
        for k in range(self.order, 0, -1):
            rows = np.flatnonzero((avail >= k - 1) & open_.any(axis=1))
            if not len(rows):
                continue
            at = self._find(self.grams, hashes[k][event[rows]])
            p = np.where((at >= 0)[:, None], self.prob[at], np.nan)
            known = ~np.isnan(p) & open_[rows]
            ctx = self._find(self.contexts, hashes[k - 1][event[rows] - 1]) if k > 1 else np.full(len(rows), self._find(self.contexts, np.zeros(1, np.uint64))[0])
            b = np.where((ctx >= 0)[:, None], self.back[ctx], 0) - (math.log2(ALPHABET) if k == 1 else 0)
            value[rows] += np.where(known, np.nan_to_num(p), np.where(open_[rows], b, 0))
            open_[rows] &= ~known
        per_token = np.array([sum(len(r) + 1 for r in rs) for rs in runs])
        some = np.flatnonzero(per_token)
        ends = np.cumsum(per_token[some])
        out[some, :-1] = np.add.reduceat(value, np.concatenate([[0], ends[:-1]]), axis=0)
        out[some, -1] = per_token[some]
        return out


class Scorer:
    """Sums of token scores over whole texts, a batch of them at a time; tokens met lately are remembered."""

    def __init__(self, models: CharModels):
        self.models = models
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.scores = np.zeros((1 << 14, len(self.models.langs) + 1), np.float32)

    def _learn(self, tokens: list[bytes]) -> None:
        n = len(self.rows)
        while len(self.scores) < n + len(tokens):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for lo in range(0, len(tokens), 20_000):
            some = tokens[lo : lo + 20_000]
            self.scores[n + lo : n + lo + len(some)] = self.models.score_tokens(some)
        self.rows.update(zip(tokens, range(n, n + len(tokens))))

    def _sums(self, words: list[list[bytes]]) -> np.ndarray:
        unknown = set().union(*words).difference(self.rows)
        if len(self.rows) + len(unknown) > CACHE_TOKENS and self.rows:
            self._reset()
            unknown = set().union(*words)
        self._learn(list(unknown))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
        out = np.zeros((len(words), self.scores.shape[1]))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.scores[at], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), axis=0, dtype=np.float64)
        return out

    def texts(self, texts: list[bytes | None]) -> np.ndarray:
        """(text, language + 1): log2 probability of each whole text in each language, and its number of characters."""
        out = np.zeros((len(texts), self.scores.shape[1]))
        held: list[list[bytes]] = []
        at: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                np.add.at(out, at, self._sums(held))
            held.clear(), at.clear()
            size = 0

        for i, t in enumerate(texts):
            words = (t or b"").lower().split()
            for lo in range(0, len(words), BATCH_TOKENS):
                held.append(words[lo : lo + BATCH_TOKENS])
                at.append(i)
                size += len(held[-1])
                if size >= BATCH_TOKENS:
                    flush()
        flush()
        return out

    def judge(self, texts: list[bytes | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, confidence from 0 to 1, bits per character, rejected) of each text."""
        m, out = self.models, []
        for total in self.texts(texts):
            n = total[-1]
            if not n or not m.langs:
                out.append((UND, 0.0, None, True))
                continue
            entropy = -total[:-1] / n
            best = int(np.argmin(entropy))
            weight = np.exp2(np.maximum(-(entropy - entropy[best]) * min(n, 64), -1000))
            rejected = False
            if m.reject is not None:
                mean, between, within, limit = m.reject[best]
                rejected = bool(entropy[best] - mean > limit * math.sqrt(between**2 + within**2 / n))
            out.append((m.langs[best], float(1 / weight.sum()), float(entropy[best]), rejected))
        return out


def fit(labelled: DataFrame, *, order: int = ORDER, train_chars: int = TRAIN_CHARS) -> CharModels:
    """Train on rows (id, text, lang), none of them null in text or lang; a bounded sample by the hash of the id."""
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["chars"] for r in labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).collect()}
    rates = {k: min(1.0, train_chars / max(1, n)) for k, n in sizes.items()}
    if not rates:
        return CharModels({}, order)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))]), F.col("lang"))
    # small corpora give all rows to both uses, as none would be left for one of them
    share = F.lit(CALIBRATION)
    sampled = labelled.select("lang", F.col("text").cast("binary").alias("text"), (draw / rate).alias("at")).filter("at < 1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words[lang].update(text.lower().split())
        for lang, found in words.items():
            grams: Counter = Counter()
            for token, c in found.items():
                for run in letter_runs(token):
                    for g in word_grams(run, order):
                        grams[g] += c
            keys = list(grams)
            for lo in range(0, len(keys), 50_000):
                some = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(some), "gram": some, "n": [grams[g] for g in some]})

    counted = sampled.filter(F.col("at") >= share).select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counted:
        counts[r["lang"]][r["gram"]] = r["n"]
    models = CharModels(counts, order)
    shipped = spark.sparkContext.broadcast(models)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for b in batches:
            out = {"lang": [], "bits": [], "n": []}
            for lang, total in zip(b.column(0).to_pylist(), scorer.texts(b.column(1).to_pylist())):
                # a text that another language's model scores better is taken as mislabelled
                if total[-1] and lang in scorer.models.langs and total[scorer.models.langs.index(lang)] >= total[:-1].max():
                    for k, v in zip(out, (lang, -total[scorer.models.langs.index(lang)] / total[-1], int(total[-1]))):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("bits", pa.float64()), ("n", pa.int64())]))

    seen = sampled.filter(F.col("at") < share).select("lang", "text").mapInArrow(calibrate, "lang string, bits double, n long").collect()
    models.reject = _limits(models.langs, [(r["lang"], r["bits"], r["n"]) for r in seen])
    return models


def _limits(langs: list[str], seen: list[tuple[str, float, int]]) -> np.ndarray:
    """Middle, spread between texts, spread within, and limit of z of each language, from calibration texts.

    Middle and spread are the median and the median deviation, so up to half of the texts may be junk. The limit is 1.5 times
    the largest z of the texts within REJECT_Z, and REJECT_Z at least: whatever lies farther out does not move it."""
    out = []
    for lang in langs:
        bits = np.array([b for x, b, _ in seen if x == lang] or [3.0])
        n = np.array([c for x, _, c in seen if x == lang] or [1])
        long = n >= 200
        middle = float(np.median(bits[long] if long.any() else bits))
        between = float(max(0.05, 1.4826 * np.median(np.abs(bits[long] - middle))) if long.sum() > 1 else 0.3)
        within = 2.5
        z = (bits - middle) / np.sqrt(between**2 + within**2 / n)
        out.append((middle, between, within, max(REJECT_Z, 1.5 * float(z[z <= REJECT_Z].max(initial=0.0)))))
    return np.array(out).reshape(len(langs), 4)


def identify(df: DataFrame, models: CharModels, id_col: str = "doc_id", text_col: str = "text", *, whole_rows: bool = False) -> DataFrame:
    """One row per input row: id, lang_pred, score, cross_entropy, rejected (and ``row``, the input row, if asked for).

    Null texts and those without a letter are ``und`` with score 0, no cross-entropy, and rejected; so is every text where
    no language was learned. Of languages that tie, the first by name. Repeated rows repeat, null ids stay null, an
    empty table gives an empty result; other columns play no part."""
    spark = df.sparkSession
    arrow_limits(spark)
    shipped = spark.sparkContext.broadcast(models)
    id_type = df.schema[id_col].dataType
    inputs = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")]
    fields = [T.StructField("id", id_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    if whole_rows:
        inputs.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
        fields.append(T.StructField("row", df.select(inputs[-1]).schema[0].dataType))

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("language", name), lambda: Scorer(shipped.value))
        for b in batches:
            lang, score, bits, rejected = zip(*scorer.judge(b.column(1).to_pylist())) if b.num_rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(rejected, pa.bool_()), *b.columns[2:]], [f.name for f in fields])

    return df.select(*inputs).mapInArrow(run, T.StructType(fields))


def fit_documents(docs: DataFrame, *, train_chars: int = TRAIN_CHARS) -> CharModels:
    """Learn from documents whose crc32(doc_id as text) mod 5 is not 0, labels and texts not null."""
    return fit(docs.filter((crc_mod(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang"), train_chars=train_chars)


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with all their columns."""
    return identify(docs, fit_documents(docs), whole_rows=True).filter(~F.col("rejected")).select("row.*")


def op1_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fit_documents(docs))
    return found.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


QUERIES = {"op1_kneser_ney_language": op1_kneser_ney_language}
