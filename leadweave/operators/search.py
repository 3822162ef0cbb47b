"""Full-text search with BM25 over a record's name, industry, region, address and e-mail.

Terms are folded to plain lower-case letters. A query's words must all occur; ``word*`` matches by prefix, ``"two words"`` as
a phrase. Every record is tokenised by each search, as no index is stored; only postings of the query's terms, and one length
a record, are exchanged. The corpus-wide figures are one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.text import or_empty, unmarked

FIELDS = ("name", "industry", "wilaya", "address", "email")
K1, B = 1.2, 0.75


def terms(c: Column) -> Column:
    """Folded tokens of a text in order: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(unmarked(or_empty(c))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(records: DataFrame) -> DataFrame:
    """(id, field, pos, term)."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("f")
    return records.select("id", fields).select("id", "f.field", F.posexplode(terms(F.col("f.text"))).alias("pos", "term"))


def parse_query(query: str) -> list[list[tuple[str, bool]]]:
    """Conjuncts of a query: each a phrase of (folded word, prefix)."""
    fold = str.maketrans({m: u for m, u in zip(_marks()[0], _marks()[1])})
    out = []
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', query):
        text = (phrase or word).translate(fold).lower()
        found = [(w, star == "*") for w, star in re.findall(r"([^\W_]+)(\*?)", text)]
        if phrase:
            found = [(w, False) for w, _ in found]
            out.append(found) if found else None
        else:
            out += [[f] for f in found]
    return out


def _marks() -> tuple[str, str]:
    from leadweave.functions.text import MARKED, UNMARKED

    return MARKED, UNMARKED


def search(records: DataFrame, query: str) -> DataFrame:
    """(id, score) of the records that match all of a query; an empty query matches none."""
    wanted = parse_query(query)
    posts = postings(records)
    lengths = records.select("id", sum((F.size(terms(F.col(f))) for f in FIELDS), F.lit(0)).cast("long").alias("len"))
    corpus = lengths.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))
    hits = None
    for k, phrase in enumerate(wanted):
        same = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
        at = posts.filter(same(*phrase[0])).select("id", "field", "pos")
        for step, word in enumerate(phrase[1:], 1):
            at = at.join(posts.filter(same(*word)).select("id", "field", (F.col("pos") - step).alias("pos")), ["id", "field", "pos"], "left_semi")
        counted = at.groupBy("id").agg(F.count("*").alias("tf")).withColumn("k", F.lit(k))
        hits = counted if hits is None else hits.unionByName(counted)
    if hits is None:
        return records.select("id", F.lit(0.0).alias("score")).limit(0)
    frequency = hits.groupBy("k").agg(F.count("*").alias("df"))  # as many rows as the query has conjuncts
    scored = hits.join(F.broadcast(frequency), "k").join(lengths, "id").crossJoin(F.broadcast(corpus))
    rare = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(rare <= 0, 1e-6).otherwise(rare)  # a term in most records hardly counts, but never against one
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") * F.col("docs") / F.col("tokens")))
    return scored.groupBy("id").agg(F.sum(weight).alias("score"), F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id", "score")


def search_leads(view: DataFrame, query: str, is_contact: bool | None = None, limit: int = 50) -> DataFrame:
    """Leads that match, best first; rejected ones never show."""
    shown = view.filter("status <> 'rejected'")
    if is_contact is not None:
        shown = shown.filter(F.col("is_contact") == is_contact)
    return shown.join(search(view, query), "id").orderBy(F.col("score").desc(), "id").limit(limit)
