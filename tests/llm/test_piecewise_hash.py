import hashlib

import pytest
import xxhash

from leadweave.llm.piecewise_hash import _common, compare_edited, fingerprint, likeness, with_next


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, "" if r[0] is None else r[0], xxhash.xxh64_intdigest(r[1].encode(), 42) + (1 << 63) & (1 << 64) - 1), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        mark, other, nxt = (fingerprint(x.encode()) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, nxt)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", ["1", "4", "9"])
def test_against_brute_force(spark, docs, odd, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        for df in (docs, odd, odd.filter("doc_id = 8"), odd.filter("doc_id < 3")):
            got = sorted(map(tuple, compare_edited(df).collect()), key=str)
            assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_locality(docs):
    texts = [r.text for r in docs.collect() if len(r.text) > 800]
    for a, b in zip(texts, texts[1:]):
        mark = fingerprint(a.encode())
        assert likeness(mark, fingerprint((a[:300] + "inserted" + a[300:]).encode())) > 0.7
        assert likeness(mark, mark) == 1
    assert fingerprint(None) == fingerprint(b"") == "4::"


def test_common_subsequence():
    import random

    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert _common(a, b) == row[-1]


def test_empty(empty):
    assert compare_edited(empty).collect() == []


@pytest.mark.parametrize("kind", ["rows", "ids", "nulls", "strings"])
def test_hot_keys(spark, kind):
    """A third of the rows repeat a row, an id or a null id: results hold, and no range has much more than its share."""
    hot = {"rows": lambda k: (77, "the same text again and again"), "ids": lambda k: (77, f"text {k} of one id"), "nulls": lambda k: (None, f"text {k} without id"), "strings": lambda k: (77, f"text {k}")}[kind]
    rows = [hot(k) if k % 3 == 0 else (k, f"document {k} " * (k % 7)) for k in range(1500)]
    if kind == "strings":
        rows = [(str(i), t) for i, t in rows]
    df = spark.createDataFrame(rows, f"doc_id {'string' if kind == 'strings' else 'long'}, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert sorted(map(tuple, compare_edited(df).collect()), key=str) == brute(rows)
        sizes = [r["count"] for r in with_next(df).groupBy("part").count().collect()]
        assert max(sizes) <= 400 and (kind == "rows" or len(sizes) == 8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
