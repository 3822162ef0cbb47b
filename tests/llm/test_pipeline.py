from collections import defaultdict

import corpus_pipeline as P
from leadweave.llm.language_id import fit_documents, identify
from tests.llm.test_simhash import brute_roots, shingles


def test_stages(spark, docs):
    given = docs.unionByName(docs.limit(3).selectExpr("doc_id + 100000 AS doc_id", "upper(text) AS text", "lang", "source", "n_chars")).unionByName(docs.limit(1).selectExpr("doc_id + 200000 AS doc_id", "'123 456' AS text", "lang", "source", "n_chars"))
    rows = {r.doc_id: r for r in given.collect()}
    rejected = {r.id for r in identify(given, fit_documents(given)).filter("rejected").collect()}
    got = given
    kept = []
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, got, "").cache()
        assert got.columns == docs.columns
        kept.append({r.doc_id for r in got.collect()})
    assert kept[0] == set(rows) - rejected and 200000 <= max(rejected)
    best = {}
    for i in kept[0]:
        key = (rows[i].text or "").encode().lower()
        best[key] = max(i, best.get(key, i))
    assert kept[1] == set(best.values())
    sets = {i: shingles(rows[i].text) for i in kept[1]}

    def smallest(least):
        links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0]
        groups = defaultdict(list)
        for i, r in brute_roots(sorted(sets), links).items():
            groups[r].append(i)
        return {min(g) for g in groups.values()}

    assert kept[2] == smallest(0.8)
    packed = P.STAGES[-1][1](spark, got, "").collect()
    assert {r.doc_id for r in packed} == kept[2]


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]
