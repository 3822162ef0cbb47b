"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A line is observed as a speaker marker (``User:``, ``### Response``, ``<|system|>`` ...), whether a record starts with it,
its length, and whether it asks. Its hidden state is a role and whether the line begins a turn of that role or goes on with it.
The model is counted from labelled records, with prior counts that tie markers to their roles; Viterbi decoding
recovers the states, and a turn is rendered as a header with its role and its lines without markers.

Records are dealt out by ranges of (conversation, turn), so one conversation may span many tasks, whatever its length.
Decoding such a conversation is still exact: a task reduces its share of it to a (max, +) matrix from the state before it
to the state at its end, the few matrices at the edges of tasks are multiplied on the driver (two a task, whatever the
data), and every task then decodes its share with the scores at its entry and the state at its exit fixed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, parts, table

ROLES = ("system", "user", "assistant")
#: States: begin of each role's turn, then going on with it.
STATES = 2 * len(ROLES)
MARKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "question", "prompt", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "response", "model", "a"),
}
_WORDS = {w: k for k, r in enumerate(ROLES) for w in MARKERS[r]}
_MARKER = re.compile(r"^[ \t]*(?:<\|([a-z_]{1,12})\|>|#{2,4}[ \t]*([a-z]{1,12})[ \t]*:?(?=\s|$)|\[([a-z]{1,12})\][ \t]*:?|\*{0,2}([a-z]{1,12})\*{0,2}[ \t]*:\*{0,2})[ \t]*", re.IGNORECASE)
#: Values of each feature: marker (none, one of the roles'), starts a record, length class, asks.
SIZES = (1 + len(ROLES), 2, 10, 2)
#: Labelled records that the model is counted from, in expectation.
TRAIN_ROWS = 20_000
#: Prior counts: a marker begins a turn of its role; other events are possible.
PRIOR_MARKER, PRIOR = 50.0, 0.5
#: Keys sampled for each range that records are dealt out by.
KEYS_PER_RANGE = 64


def observe(line: str, first: bool) -> tuple[tuple[int, int, int, int], str]:
    """Features of a line, and the line without its marker."""
    m = _MARKER.match(line)
    role = _WORDS.get(next(g for g in m.groups() if g is not None).lower()) if m else None
    return (0 if role is None else 1 + role, int(first), min(len(line).bit_length(), SIZES[2] - 1), int(line.rstrip().endswith("?"))), line if role is None else line[m.end() :]


def lines_of(text: str | None) -> list[str]:
    """A record's lines; null and empty: one empty line."""
    return (text or "").split("\n")


class TranscriptModel:
    """Log probabilities: start (state), move (state, state), emit[feature] (state, value)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        n = len(ROLES)
        start, move = start.astype(float) + PRIOR, move.astype(float) + PRIOR
        start[n:] = 1e-9  # a conversation begins with a turn
        for r in range(n):  # a turn goes on with its own role only
            for s in range(n):
                if r != s:
                    move[[r, n + r], n + s] = 1e-9
        emit = [e.astype(float) + PRIOR for e in emit]
        emit[0][:n, 1:] += PRIOR_MARKER * np.eye(n)
        emit[0][:, 0] += PRIOR_MARKER
        emit[0][n:, 1:] *= 1e-3  # markers within a turn are rare
        emit[1][n:, 1] *= 1e-2  # as are records that go on with a turn
        self.start, self.move, self.emit = log(start), log(move), [log(e) for e in emit]

    def emissions(self, seen: list[tuple[int, int, int, int]]) -> np.ndarray:
        x = np.array(seen)
        return sum(e[:, x[:, k]].T for k, e in enumerate(self.emit))

    def matrix(self, seen: list) -> np.ndarray:
        """(max, +): from the state before the lines to the state at the last."""
        out = np.full((STATES, STATES), -np.inf)
        np.fill_diagonal(out, 0.0)
        for e in self.emissions(seen):
            out = (out[:, :, None] + self.move[None]).max(axis=1) + e
        return out

    def decode(self, seen: list, entry: np.ndarray | None = None, last: int | None = None) -> tuple[list[int], np.ndarray]:
        """Best states, and the scores at the last line. ``entry``: scores of the states before the lines (none: the conversation
        begins here); ``last``: the state to end in. Of equal scores the first state wins."""
        e = self.emissions(seen)
        v = (self.start if entry is None else (entry[:, None] + self.move).max(axis=0)) + e[0]
        came = []
        for x in e[1:]:
            step = v[:, None] + self.move
            came.append(step.argmax(axis=0))
            v = step.max(axis=0) + x
        path = [int(v.argmax()) if last is None else last]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        return path[::-1], v


def fit(rows: DataFrame, *, train_rows: int = TRAIN_ROWS) -> TranscriptModel:
    """Count a model from rows (conv, turn, role, text): those of a bounded sample of conversations whose role is one of ROLES."""
    n = rows.count()
    rate = min(1.0, train_rows / max(1, n))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "conv"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter((draw < rate) & F.col("role").isin(*ROLES) & F.col("turn").isNotNull())
    # neighbours by an equi-join on the next turn: no window over a conversation of any length
    after = sample.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    pairs = {(r["role"], r["next_role"]): r["n"] for r in sample.join(after, ["conv", "turn"]).groupBy("role", "next_role").agg(F.count("*").alias("n")).collect()}
    firsts = {r["role"]: r["n"] for r in sample.groupBy("conv").agg(F.min_by("role", "turn").alias("role")).groupBy("role").agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = ROLES.index(role)
                for i, line in enumerate(lines_of(text)):
                    state = r if i == 0 else len(ROLES) + r
                    for k, v in enumerate(observe(line, i == 0)[0]):
                        cells[k, state, v] = cells.get((k, state, v), 0) + 1
        if cells:
            ks, ss, vs = zip(*cells)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (ks, ss, vs)] + [pa.array(list(cells.values()), pa.int64())], ["k", "state", "v", "n"])

    emit = [np.zeros((STATES, s)) for s in SIZES]
    for c in sample.select("role", "text").mapInArrow(count, "k int, state int, v int, n long").groupBy("k", "state", "v").agg(F.sum("n").alias("n")).collect():
        emit[c["k"]][c["state"], c["v"]] = c["n"]
    m = len(ROLES)
    start, move = np.zeros(STATES), np.zeros((STATES, STATES))
    for r, role in enumerate(ROLES):
        start[r] = firsts.get(role, 0)
        begins, goes_on = emit[1][r].sum(), emit[1][m + r].sum()
        many = goes_on / max(1.0, begins + goes_on)  # share of lines that another line of the turn follows
        move[r, m + r] = move[m + r, m + r] = begins * many
        for s, after_role in enumerate(ROLES):
            move[r, s] = move[m + r, s] = pairs.get((role, after_role), 0) * (1 - many)
    return TranscriptModel(start, move, emit)


def _key(row: tuple) -> tuple:
    """Order of records: conversation, turn, hash of the text, a number of the row; nulls first."""
    return tuple((x is not None, x) if x is not None else (False, 0) for x in row)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, list[dict]]]:
    """(range, conversation, rows) of a task's sorted rows."""
    at, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            if (row["part"], row["conv"]) != at:
                if rows:
                    yield *at, rows
                at, rows = (row["part"], row["conv"]), []
            rows.append(row)
    if rows:
        yield *at, rows


def _seen(rows: list[dict]) -> list[tuple[int, int, int, int]]:
    return [observe(line, i == 0)[0] for r in rows for i, line in enumerate(lines_of(r["text"]))]


def _edges(model: TranscriptModel):
    """The first and the last conversation of each range: matrix over its share, and scores if it begins here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, conv, rows: list[dict], place: str) -> pa.RecordBatch:
            seen = _seen(rows)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv": [str(conv)], "none": [conv is None], "place": [place], "matrix": [model.matrix(seen).ravel().tolist()], "begin": [model.decode(seen)[1].tolist()]})

        held = None
        for part, conv, rows in _conversations(batches):
            if held and held[0] == part:
                if held[3]:
                    yield out(*held[:3], "first")
                held = (part, conv, rows, False)
            else:
                if held:
                    yield out(*held[:3], "both" if held[3] else "last")
                held = (part, conv, rows, True)
        if held:
            yield out(*held[:3], "both" if held[3] else "last")

    return run


def _across(edges: list) -> dict[tuple[int, str, bool], tuple[list[float] | None, int | None]]:
    """Entry scores and exit state of each share of the conversations that span ranges."""
    shares: dict[tuple[str, bool], list] = {}
    for e in edges:
        shares.setdefault((e["conv"], e["none"]), []).append(e)
    plan = {}
    for conv, es in shares.items():
        es.sort(key=lambda e: e["part"])
        if len(es) < 2:
            continue
        scores = [np.array(es[0]["begin"])]
        moves = [np.array(e["matrix"]).reshape(STATES, STATES) for e in es]
        for m in moves[1:]:
            scores.append((scores[-1][:, None] + m).max(axis=0))
        state = int(scores[-1].argmax())
        for i in range(len(es) - 1, -1, -1):
            plan[(es[i]["part"], *conv)] = (None if i == 0 else scores[i - 1].tolist(), state)
            if i:
                state = int((scores[i - 1] + moves[i][:, state]).argmax())
    return plan


def _render(model: TranscriptModel, plan: dict, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(ROLES)
        for part, conv, rows in _conversations(batches):
            entry, last = plan.get((part, str(conv), conv is None), (None, None))
            path, _ = model.decode(_seen(rows), None if entry is None else np.array(entry), last)
            out, at = [], 0
            for r in rows:
                pieces: list[dict] = []
                for i, line in enumerate(lines_of(r["text"])):
                    state, bare = path[at], observe(line, i == 0)[1]
                    at += 1
                    if state < m or not pieces:
                        pieces.append({"conv": conv, "turn": r["turn"], "segment": len(pieces), "role": ROLES[state % m], "given_role": r["role"], "starts_turn": state < m, "lines": []})
                    pieces[-1]["lines"].append(bare)
                for p in pieces:
                    body = "\n".join(p.pop("lines"))
                    out.append(p | {"text": body, "rendered": (f"<|{p['role']}|>\n" if p["starts_turn"] else "") + body + "\n"})
            for lo in range(0, len(out), 1000):
                yield pa.RecordBatch.from_pylist(out[lo : lo + 1000], schema=schema)

    return run


def format_chats(df: DataFrame, model: TranscriptModel, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per record and turn in it: conv, turn, segment (from 0), role, given_role, starts_turn, text, rendered.

    Roles come from the texts and their order alone. Records are ordered by turn, then the text's hash, nulls first; a null
    conversation is a conversation of its own; null and empty texts are one empty line; repeated records repeat. A record that
    holds several speakers gives a row for each of their turns. The rendered rows of a conversation, joined in order, are
    its canonical form. An empty table gives an empty result; other columns play no part."""
    spark = df.sparkSession
    arrow_limits(spark)
    n = parts(spark)
    conv_type, turn_type = df.schema[conv_col].dataType, df.schema[turn_col].dataType
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in ((conv_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    # the last part of the key tells repeated rows apart, so that they too are dealt to many ranges
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    sample = rows.filter(F.rand(11) < KEYS_PER_RANGE * n / max(1, df.count())).select("conv", "turn", "mark", "salt").collect()
    keys = sorted(_key(tuple(r)) for r in sample)
    cuts = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = [bisect_left(cuts, _key(k)) for k in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5)))]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], ["part", *b.schema.names])

    dealt_type = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("conv", conv_type), T.StructField("turn", turn_type), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("mark", T.LongType()), T.StructField("salt", T.LongType())])
    dealt = rows.mapInArrow(deal, dealt_type).repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "mark", "salt")
    edge_type = "part int, conv string, none boolean, place string, matrix array<double>, begin array<double>"
    plan = _across(dealt.mapInArrow(_edges(model), edge_type).collect())
    probe = rows.select("conv", "turn").limit(0).toArrow().schema
    out = pa.schema([("conv", probe.field("conv").type), ("turn", probe.field("turn").type), ("segment", pa.int32()), ("role", pa.string()), ("given_role", pa.string()), ("starts_turn", pa.bool_()), ("text", pa.string()), ("rendered", pa.string())])
    out_type = T.StructType([T.StructField("conv", conv_type), T.StructField("turn", turn_type), T.StructField("segment", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("given_role", T.StringType()), T.StructField("starts_turn", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("rendered", T.StringType())])
    return dealt.mapInArrow(_render(model, plan, out), out_type)


def op5_hmm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    model = fit(rows.withColumnRenamed("conv_id", "conv"))
    return format_chats(rows, model).withColumnRenamed("conv", "conv_id")


QUERIES = {"op5_hmm_transcripts": op5_hmm_transcripts}
