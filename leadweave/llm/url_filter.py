"""URL filters on a bit-parallel wildcard automaton.

All glob rules live in one Shift-And automaton: every token of a pattern (a literal byte, ``*`` for any run of bytes, or
``~`` for any run without ``/``) is a bit of a multiword state, and a batch of URLs advances together, one byte at a
time, by a shift with carry and a handful of mask operations on numpy arrays. One pass over a canonical URL therefore
simulates all rules at once, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave.llm._shared import arrow_limits, lower_ascii, table

ALLOW, BLOCK = "allow", "block"
#: URLs advanced together; sorted by length first, so that a long one does not hold up a batch of short ones.
STEP = 2048


@dataclass(frozen=True)
class Rule:
    """``host/path`` with its verdict: fits the host and its subdomains where the path starts with the rule's."""

    verdict: str
    name: str

    @property
    def glob(self) -> str:
        host, _, path = self.name.partition("/")
        return f"~.{host.lower()}/{path}*"


#: The rules of the query, in the order in which they were given.
RULES = (Rule(BLOCK, "com/en/"), Rule(ALLOW, "example.com/en/7"), Rule(ALLOW, "net/de/"), Rule(BLOCK, "example.net/de/8"), Rule(BLOCK, "org/es/"))


class ShiftAnd:
    """Glob patterns packed side by side into the words of one automaton; matches are of whole strings.

    A state bit stands for "the pattern is matched up to before this token"; each pattern has one more bit, its end.
    Run tokens (``*``, ``~``) may be skipped, which an addition-free closure does by shifting their bits on: two run
    tokens never stand side by side, so one shift is enough."""

    def __init__(self, globs: Sequence[str]):
        starts, ends, skip, runs, literals = [], [], [], [], []
        n = 0
        for g in globs:
            starts.append(n)
            before = b""
            for c in (bytes([x]) for x in g.encode()):
                if c in b"*~":
                    if before and before in b"*~":
                        raise ValueError(f"two wildcards side by side: {g}")
                    skip.append(n)
                    runs.append((n, c == b"~"))
                else:
                    literals.append((n, c[0]))
                n, before = n + 1, c
            ends.append(n)
            n += 1
        self.words = max(1, -(-n // 64))
        self.ends = ends
        # masks[c]: tokens that byte c passes; stay[c]: run tokens that byte c keeps open
        self.masks, self.stay = (np.zeros((256, self.words), np.uint64) for _ in range(2))
        self.skip, self.start = (np.zeros(self.words, np.uint64) for _ in range(2))
        for at, c in literals:
            self.masks[c, at // 64] |= np.uint64(1 << at % 64)
        for at, in_host in runs:
            for c in range(256):
                if not (in_host and c == ord("/")):
                    self.stay[c, at // 64] |= np.uint64(1 << at % 64)
        for into, bits in ((self.skip, skip), (self.start, starts)):
            for at in bits:
                into[at // 64] |= np.uint64(1 << at % 64)

    def _shift(self, s: np.ndarray) -> np.ndarray:
        out = s << np.uint64(1)
        out[:, 1:] |= s[:, :-1] >> np.uint64(63)
        return out

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean (text, pattern)."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for lo in range(0, len(order), STEP):
            rows = order[lo : lo + STEP]
            lengths = np.array([len(texts[i]) for i in rows])
            codes = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            state = np.tile(self.start, (len(rows), 1))
            state |= self._shift(state & self.skip)
            for at in range(lengths.max(initial=0)):
                live = int(np.searchsorted(lengths, at, "right"))  # rows before it have ended
                c, s = codes[first[live:] + at], state[live:]
                s = self._shift(s & self.masks[c]) | s & self.stay[c]
                state[live:] = s | self._shift(s & self.skip)
            for p, e in enumerate(self.ends):
                out[rows, p] = state[:, e // 64] >> np.uint64(e % 64) & np.uint64(1)
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES, otherwise: str = ALLOW) -> DataFrame:
    """(id, host, path, rule, verdict): of the rules that fit, the one with the longest name decides; none: ``otherwise``.

    Rows keep their number: repeated ids repeat, null ids stay null. A null URL, or one without ``://``, has an empty host
    and path and fits no rule. An empty table gives an empty result."""
    arrow_limits(df.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ShiftAnd([r.glob for r in ranked])
        for b in batches:
            # the dot before the host makes a host its own subdomain
            fits = auto.matches([b"." + h + p for h, p in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).cast(pa.binary()).to_pylist())])
            best = [int(i) if any_ else None for i, any_ in zip(fits.argmax(axis=1), fits.any(axis=1))] if ranked else [None] * b.num_rows
            rule = pa.array([None if i is None else ranked[i].name for i in best], pa.string())
            verdict = pa.array([otherwise if i is None else ranked[i].verdict for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], ["id", "host", "path", "rule", "verdict"])

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType)] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    url = F.col(f"`{url_col}`")
    return df.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(run, schema)


def op9_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).withColumnRenamed("id", "page_id")


def _sql() -> str:
    fits = lambda r: f"(h = '{r.name.partition('/')[0]}' OR ends_with(h, '.{r.name.partition('/')[0]}')) AND starts_with(p, '/{r.name.partition('/')[2]}')"
    ranked = sorted(RULES, key=lambda r: -len(r.name))
    case = lambda v: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v(r)}'" for r in ranked)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p FROM u)
SELECT page_id, h AS host, p AS path, {case(lambda r: r.name)} END AS rule, {case(lambda r: r.verdict)} ELSE 'allow' END AS verdict FROM s"""


SQL = {"op9_url_globs": _sql()}
QUERIES = {"op9_url_globs": op9_url_globs}
