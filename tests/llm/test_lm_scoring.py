import math
import zlib
from collections import Counter

import numpy as np
import pytest

from leadweave.llm.lm_scoring import BUCKETS, bucket, score_texts, weights


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7


def model(rows):
    """Counts of all training texts, and the weights that EM finds without a grid."""
    uni, bi, left_uni, left_bi, held = Counter(), Counter(), Counter(), Counter(), []
    for i, t in rows:
        if fold(i) == 2:
            continue
        w = tokens(t)
        pairs = list(zip(["<s>", *w], w))
        uni.update(w), bi.update(pairs)
        if fold(i) == 3:
            held += pairs
        else:
            left_uni.update(w), left_bi.update(pairs)
    return uni, bi, left_uni, left_bi, held


@pytest.mark.parametrize("size", [1 << 14, 1 << 23])
def test_against_brute_force(docs, odd, size):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        uni, bi, left_uni, left_bi, held = model(rows)
        n, v = sum(uni.values()), len(uni)
        ends = {c: (k["<s>"] if "<s>" in k else k[None]) for c, k in (("all", uni), ("left", left_uni))}
        alpha = brute_weights(left_uni, left_bi, held, v, ends["left"])
        got = sorted((tuple(r) for r in score_texts(df, block_bytes=size).collect()), key=str)
        expect = []
        for i, t in rows:
            w = tokens(t)
            base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
            score = 0.0
            for a, b in zip(["<s>", *w], w):
                c = ends["all"] if a == "<s>" else uni[a]
                k = alpha[min(c.bit_length(), BUCKETS - 1)]
                score += math.log10((k[0] * bi[a, b] / c if c else 0) + k[1] * uni[b] / max(1, n) + k[2] / (v + 1))
            expect.append((i, fold(i) == 2, len(w), sum(uni[x] > 0 for x in w), n, base, score))
        expect.sort(key=str)
        assert [g[:5] for g in sorted(got, key=lambda g: str(g[:5]))] == [e[:5] for e in sorted(expect, key=lambda e: str(e[:5]))]
        key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 4))
        for g, e in zip(sorted(got, key=key), sorted(expect, key=key)):
            assert g[5] == pytest.approx(e[5], rel=1e-9)
            # the weights are learned on a grid of quarter doublings
            assert g[6] == pytest.approx(e[6], rel=0.02)


def brute_weights(uni, bi, held, v, ends):
    n = sum(uni.values())
    by = {}
    for a, b in held:
        c = ends if a == "<s>" else uni[a]
        by.setdefault(min(c.bit_length(), BUCKETS - 1), []).append([bi[a, b] / c if c else 0.0, uni[b] / max(1, n), 1 / (v + 1)])

    def learn(x, use):
        x, w = np.array(x), use / use.sum()
        for _ in range(60):
            s = x * w
            s /= s.sum(axis=1, keepdims=True)
            w = (s.sum(axis=0) + use) / (len(x) + use.sum())
        return w

    pooled = learn([y for x in by.values() for y in x], np.ones(3)) if by else np.full(3, 1 / 3)
    out = []
    for k in range(BUCKETS):
        use = np.array([float(k > 0), 1.0, 1.0])
        out.append(learn(by[k], use) if k in by else pooled * use / (pooled * use).sum())
    return out


def test_better_than_base(spark):
    rows = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    w = weights(np.array([], np.int64), np.array([]))
    assert np.allclose(w.sum(axis=1), 1) and w[0, 0] == 0
    assert bucket(np.array([0, 1, 2, 3, 4, 1 << 40])).tolist() == [0, 1, 2, 2, 3, BUCKETS - 1]


def test_empty(empty):
    assert score_texts(empty).collect() == []
