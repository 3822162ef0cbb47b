import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from leadweave.llm.exact_dedup import ContentTable, drop_exact_copies, grace_dedup, leaf_column


def norm(t):
    return (t or "").encode().lower()


def check(rows, out):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    assert len(out) == len(rows)
    kept = defaultdict(int)
    for r in out:
        ids = by_sha[r["sha256"]]
        assert r["group_size"] == len(ids) and r["id"] in ids
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["sha256"]] += r["kept"]
        assert not r["kept"] or r["id"] == r["keep_id"]
    assert set(kept.values()) <= {1}


def test_table_compares_contents():
    t = ContentTable(4)
    assert [t.add(5, b"a"), t.add(5, b"b"), t.add(5, b"a"), t.add(9, b"a")] == [(0, True), (1, True), (0, False), (2, True)]
    many = ContentTable(4)
    assert [many.add(i % 7, b"%d" % i)[0] for i in range(500)] == list(range(500))
    assert not any(many.add(i % 7, b"%d" % i)[1] for i in range(500))


def test_against_brute_force(docs, odd):
    for df in (docs, odd):
        check([(r.doc_id, r.text) for r in df.collect()], grace_dedup(df).collect())


def test_recursion(docs):
    out = grace_dedup(docs, bucket_bytes=2000)
    check([(r.doc_id, r.text) for r in docs.collect()], out.collect())
    reps = docs.select(F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("content"))
    leaf, first = leaf_column(reps, 4000)
    sizes = reps.groupBy(leaf.alias("leaf")).agg(F.sum(F.octet_length("content")).alias("b"), F.countDistinct("hash").alias("n")).collect()
    assert first > 1 and all(r.b <= 4000 or r.n == 1 for r in sizes) and any("." in r.leaf for r in sizes)


def test_whole_rows(odd):
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in odd.collect()})


def test_empty(empty):
    assert grace_dedup(empty).collect() == [] and drop_exact_copies(empty).collect() == []
