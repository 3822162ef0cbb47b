"""Column functions over text: keys, clean-up, similarity, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that a snippet's clean-up decodes, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"))

# A query with one of these is refused.
INJECTIONS = (r"(?s)\{\{.*\}\}", r"(?s)\{%.*%\}", r"(?s)\$\{.*\}", r"--", r"(?i);\s*drop\b", r"(?i)<script")
#: Letters, digits, underscores, white space, accented Latin, Arabic, hyphens and apostrophes may stay in a query.
QUERY_STRAYS = r"(?U)[^\w\sÀ-ÿ؀-ۿݐ-ݿ\-']"
MAX_QUERY = 200

#: Latin letters with marks and what is left of them: enough for the names of the market, all from one rule.
_PLAIN = {"a": "àáâãäåā", "c": "çćč", "e": "èéêëēė", "i": "ìíîïī", "n": "ñń", "o": "òóôõöō", "u": "ùúûüū", "y": "ýÿ", "s": "š", "z": "žźż"}
MARKED = "".join(v for v in _PLAIN.values()) + "".join(v.upper() for v in _PLAIN.values())
UNMARKED = "".join(k * len(v) for k, v in _PLAIN.items()) + "".join(k.upper() * len(v) for k, v in _PLAIN.items())


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def none_if_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def web_key(url: Column) -> Column:
    """A site's identity: lower case without schemes, any ``www.``, and slashes at the ends; null: empty."""
    c = F.lower(or_empty(url))
    for part in ("https://", "http://", "www."):
        c = F.replace(c, F.lit(part), F.lit(""))
    return F.btrim(c, F.lit("/"))


def digits(c: Column) -> Column:
    return F.regexp_replace(or_empty(c), r"(?U)\D", "")


def fingerprint(name: Column, region: Column, phone: Column, website: Column) -> Column:
    """``name|region|phone|web``: the identity of a record within a run."""
    return F.concat_ws("|", F.lower(F.regexp_replace(or_empty(name), r"[^\p{L}\p{N}]", "")), F.lower(F.trim(or_empty(region))), digits(phone), web_key(website))


def unmarked(c: Column) -> Column:
    return F.translate(c, MARKED, UNMARKED)


def name_key(name: Column) -> Column:
    """ASCII letters and digits only, marks dropped, lower case."""
    return F.lower(F.regexp_replace(unmarked(or_empty(name)), "[^A-Za-z0-9]", ""))


def strip_tags(html: Column) -> Column:
    c = F.regexp_replace(or_empty(html), "<[^>]+>", "")
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return squeeze(c)


def ellipsis(c: Column, most: int = 120) -> Column:
    """Cut to ``most - 3`` characters and a dot triplet sign where longer than ``most``; up to 3: a plain cut."""
    c = or_empty(c)
    cut = F.substring(c, 1, most) if most <= 3 else F.concat(F.substring(c, 1, most - 3), F.lit("…"))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def sanitised_query(q: Column) -> Column:
    """The query without stray characters, at most 200 of them, cut at a space; null where it is empty or refused."""
    bad = F.lit(False)
    for p in INJECTIONS:
        bad = bad | or_empty(q).rlike(p)
    clean = squeeze(F.regexp_replace(or_empty(q), QUERY_STRAYS, " "))
    head = F.substring(clean, 1, MAX_QUERY)
    clean = F.when(F.length(clean) <= MAX_QUERY, clean).when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(~bad & (clean != ""), clean)


def query_fault(q: Column) -> Column:
    """Why a query is refused: ``empty``, ``forbidden`` or null."""
    bad = F.lit(False)
    for p in INJECTIONS:
        bad = bad | or_empty(q).rlike(p)
    return F.when(or_empty(q) == "", "empty").when(bad, "forbidden").when(sanitised_query(q).isNull(), "empty")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, case aside; both empty 1, one empty 0."""
    a, b = or_empty(a), or_empty(b)
    x, y = F.lower(a), F.lower(b)
    return (
        F.when((a == "") & (b == ""), 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .otherwise(F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


SHORT_BLOCK = "__short__"


def trigrams(name: Column) -> Column:
    """Distinct trigrams of the lower-case ASCII letters and digits; under three of them: one block for all short names."""
    bare = F.regexp_replace(F.lower(or_empty(name)), "[^a-z0-9]", "")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 2, F.lit(1))), lambda i: F.substring(bare, i, F.lit(3)))
    return F.when(F.length(bare) < 3, F.array(F.lit(SHORT_BLOCK))).otherwise(F.array_distinct(cut))


def first_of_each(items: Column) -> Column:
    """Trimmed strings in order, the first of those that differ in case alone; blanks go."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def name_label(name: Column) -> Column:
    return F.substring(F.trim(name), 1, 200)


def cache_key(model: Column, prompt: Column) -> Column:
    """SHA-256 of ``model::prompt``; its first two digits name the shard."""
    return F.sha2(F.concat_ws("::", model, prompt), 256)


def words(*columns: Column) -> Column:
    """Search tokens of several columns: runs of word characters, hyphens and apostrophes, two characters at least."""
    found = F.regexp_extract_all(F.concat_ws("\n", *columns), F.lit(r"(?U)\b[\w\-']+\b"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)
