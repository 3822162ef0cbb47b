import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadweave.operators.components import connected_components
from leadweave.llm.simhash import ball_links, drop_near_copies, near_components, shingle_ranks, shingle_set, similar_links, simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_against_brute_force(docs, odd):
    for df in (docs, odd):
        rows = [(r.doc_id, brute_fp(r.text)) for r in df.collect()]
        fps = sorted({f for _, f in rows})
        root = brute_roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
        ids = defaultdict(list)
        for i, f in rows:
            if i is not None:
                ids[root[f]].append(i)
        expect = [(i, f, min(ids[root[f]], default=None)) for i, f in rows]
        got = [(r.id, r.fp & (1 << 64) - 1, r.component) for r in near_components(df).collect()]
        assert sorted(got, key=str) == sorted(expect, key=str)


def test_shingles_of_spark_hash(spark):
    assert simhash(b"A b") == spark.sql("select xxhash64('a b')").first()[0] & (1 << 64) - 1


def test_ball_links(spark):
    import random

    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for f in list(fps):
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")
    for radius in (2, 4):
        got = brute_roots(range(len(fps)), [(r.a, r.b) for r in ball_links(classes.filter(F.col("rep") < 60) if radius == 4 else classes, radius).collect()])
        n = 60 if radius == 4 else len(fps)
        expect = brute_roots(range(len(fps)), [(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius])
        assert got == expect
    with pytest.raises(ValueError):
        ball_links(classes, 3)


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components(spark, kind):
    import random

    rng = random.Random(7)
    links = {"chain": [(i, i + 1) for i in range(60)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], "star": [(500, i) for i in range(90)], "none": []}[kind]
    rng.shuffle(links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_roots(nodes, [x for x in links if x[0] != x[1]])


def test_empty(empty):
    assert near_components(empty).collect() == []


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies(spark, docs):
    """Planted copies with up to 2 words in 100 changed go, all others stay."""
    import random

    rng = random.Random(11)
    base = [(r.doc_id, r.text) for r in docs.collect() if len(r.text.split()) >= 60]
    planted = []
    for k, (i, t) in enumerate(base):
        for c in range(1 + k % 3):
            words = t.split()
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words[at] = f"other{at}"
            planted.append((10_000 + 10 * i + c, " ".join(words)))
    near = [(i, t) for i, t in planted if len(shingles(t) & shingles(dict(base)[(i - 10_000) // 10])) >= 0.83 * len(shingles(t) | shingles(dict(base)[(i - 10_000) // 10]))]
    assert len(near) > 100
    df = spark.createDataFrame(base + near, "doc_id long, text string")
    links = {(r.a, r.b) for r in similar_links(df).collect()}
    texts = dict(base + near)
    for a, b in links:
        x, y = shingles(texts[a]), shingles(texts[b])
        assert len(x & y) / len(x | y) >= 0.8
    kept = {r.doc_id for r in drop_near_copies(df).collect()}
    assert not [i for i, _ in near if i in kept]
    alone = [i for i, t in base if not any(j != i and len(shingles(t) & shingles(u)) >= 0.7 * len(shingles(t) | shingles(u)) for j, u in base)]
    assert set(alone) <= kept


def test_ranks_count_all_texts(spark, docs):
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    sets = [shingle_set(r.text) for r in texts.collect()]
    held = np.zeros(1 << 22)
    for x in sets:
        np.add.at(held, (x >> np.uint64(42)).astype(np.int64), 1)
    assert (shingle_ranks(texts, 5) == np.minimum(255, np.round(8 * np.log2(1 + held)))).all()


def test_near_copies_of_odd_rows(odd, empty):
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 2 and kept.filter("doc_id = 2").count() == 0
    assert drop_near_copies(empty).collect() == []


def replaced(rng, words, low, high):
    """The text with one contiguous passage replaced, at a similarity of low to high."""
    while True:
        n = rng.randrange(len(words) // 20, len(words) // 5)
        at = rng.randrange(len(words) - n)
        new = words[:at] + [f"other{rng.randrange(10**6)}" for _ in range(n)] + words[at + n :]
        x, y = shingles(" ".join(words)), shingles(" ".join(new))
        if low <= len(x & y) / len(x | y) < high:
            return " ".join(new)


def linked(spark, rows):
    links = [(r.a, r.b) for r in similar_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    return links, brute_roots([i for i, _ in rows], links)


def test_contiguous_edits_at_the_threshold(spark):
    import random

    rng = random.Random(21)
    rows = []
    for k in range(60):
        words = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(320, 900))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, replaced(rng, words, 0.8, 0.85))]
    _, root = linked(spark, rows)
    assert all(root[2 * k] == root[2 * k + 1] for k in range(60))


def test_closed_vocabulary_and_unrelated_hubs(spark):
    """Texts of the same words, and true pairs whose members all meet an unrelated text of smaller id first."""
    import random

    rng = random.Random(22)
    rows = []
    for k in range(40):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(1500, 2000))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, replaced(rng, words, 0.85, 0.95))]
    common = [f"c{i}" for i in range(40)]
    pairs = []
    for k in range(30):
        words = common + [f"u{k}x{i}" for i in range(60)]
        rows.append((1000 + 2 * k, " ".join(words)))
        rows.append((1001 + 2 * k, " ".join(words[:-5] + [f"y{k}x{i}" for i in range(5)])))
        pairs.append((1000 + 2 * k, 1001 + 2 * k))
    rows.append((-1, " ".join(common + [f"hub{i}" for i in range(60)])))
    _, root = linked(spark, rows)
    assert all(root[2 * k] == root[2 * k + 1] for k in range(40)) and all(root[a] == root[b] for a, b in pairs)
    assert len(set(root.values())) == 71


def test_left_over_pairs_of_a_group(spark, monkeypatch):
    """All texts meet at frequent shingles only, where the smallest id is similar to none of them."""
    import leadweave.llm.simhash as S

    def ranked_last(texts, width):
        h = np.unique(np.concatenate([S.shingle_set(r.text, width) for r in texts.filter("id < 10").collect()]))
        ranks = np.zeros(1 << S.SKETCH_BITS, np.uint8)
        ranks[S._counter(h[~np.isin(h, S.shingle_set(" ".join(shared).encode(), width))])] = 1
        return ranks

    shared = [f"s{i}" for i in range(60)]
    base = [f"t{i}" for i in range(60)]
    near = [(k, " ".join(shared + base[:-2] + [f"e{k}", f"f{k}"])) for k in (2, 3)]
    hub = [(1, " ".join(shared + [f"h{i}" for i in range(60)]))]
    monkeypatch.setattr(S, "shingle_ranks", ranked_last)
    _, root = linked(spark, hub + near)
    assert root == {1: 1, 2: 2, 3: 2}


def test_links_are_exact_for_long_texts(spark):
    import random

    rng = random.Random(23)
    rows = []
    for k in range(80):
        words = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(600, 900))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, replaced(rng, words, *((0.8, 0.82) if k % 2 else (0.78, 0.8))))]
    links, _ = linked(spark, rows)
    assert sorted(links) == [(2 * k, 2 * k + 1) for k in range(1, 80, 2)]


def test_shared_passage_and_copies_around_an_original(spark):
    """Texts that share a passage stay apart; copies that are each similar to an original only are one group."""
    import random

    rng = random.Random(24)
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join([f"a{k}x{i}" for i in range(10)] + passage + [f"b{k}x{i}" for i in range(10)])) for k in range(150)]
    words = [f"o{i}" for i in range(200)]
    rows += [(1000, " ".join(words))] + [(500 + k, replaced(rng, words, 0.82, 0.86)) for k in range(40)]
    _, root = linked(spark, rows)
    assert all(root[k] == k for k in range(150)) and {root[k] for k in [1000, *range(500, 540)]} == {500}


def brute_signs(text):
    """Four fingerprints of 32 bits over the distinct three-word shingles."""
    out = []
    words = text.encode().lower().split()
    words = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    for k in (1, 2):
        ones = [0] * 64
        for w in words:
            x = (xxhash.xxh64_intdigest(w, 42) ^ k * 0x9E3779B97F4A7C15 % 2**64) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            x ^= x >> 31
            ones = [n + (x >> b & 1) for b, n in enumerate(ones)]
        out += [sum(1 << b for b in range(32) if 2 * ones[at + b] > len(words)) for at in (0, 32)]
    return out


def test_fingerprints_find_near_copies_before_the_exact_search(spark, monkeypatch):
    """Without the exact search: near copies of which a fingerprint is in reach are one group, and no others; with it: all."""
    import random

    import leadweave.llm.simhash as S

    rng = random.Random(25)
    rows = [(-1, ""), (-2, None), (-3, " ")]
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(400)]
        rows.append((100 * k, " ".join(words)))
        for c in range(1, 6):
            new = list(words)
            new[rng.randrange(400)] = f"Other{c}"
            rows.append((100 * k + c, " ".join(new)))
        rows.append((100 * k + 9, replaced(rng, words, 0.84, 0.88)))
    sets = {i: shingles(t) for i, t in rows}
    signs = {i: brute_signs(t or "") for i, t in rows}
    similar = [(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0]
    apart = {(a, b): [(x ^ y).bit_count() for x, y in zip(signs[a], signs[b])] for a, b in similar}
    reached = [p for p, n in apart.items() if min(n) <= 2 and sum(n) <= 32]
    assert len(reached) > 400
    assert linked(spark, rows)[1] == brute_roots(list(sets), similar) != brute_roots(list(sets), reached)
    monkeypatch.setattr(S, "prefix", lambda hashes, ranks, least: hashes[:0])
    assert linked(spark, rows)[1] == brute_roots(list(sets), reached)
