import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadweave.llm.language_id import CharModels, Scorer, drop_rejected, end_hashes, fit_documents, gram_hash, identify, kneser_ney, letter_runs, op1_kneser_ney_language, word_grams

SMALL = "/root/testdata/sf0.01"


def counts(text, order=5):
    out = {}
    for w in text.split():
        for g in word_grams(w, order):
            out[g] = out.get(g, 0) + 1
    return out


def test_probabilities_sum_to_one():
    prob, back = kneser_ney(counts("abra cadabra abracadabra bar barca cab", 3), 3)
    alphabet = sorted({g[-1] for g in prob})

    def p(c, ctx):
        if ctx + c in prob:
            return 2 ** prob[ctx + c]
        if not ctx:
            return 2 ** back[""] / 4096
        return (2 ** back[ctx] if ctx in back else 1) * p(c, ctx[1:])

    for ctx in back:
        assert math.isclose(sum(p(c, ctx) for c in alphabet) + (4096 - len(alphabet)) * p("￿", ctx), 1, rel_tol=1e-6)


def test_hash_arrays_against_dictionaries():
    texts = {"x": "der die das und nicht ein eine einer keine", "y": "the this that not one and a another none"}
    tables = {k: kneser_ney(counts(v)) for k, v in texts.items()}
    models = CharModels({k: counts(v) for k, v in texts.items()})

    def score(w, prob, back):
        total = 0.0
        for g in word_grams(w):
            while g not in prob and len(g) > 1:
                total += back.get(g[:-1], 0.0)
                g = g[1:]
            total += prob.get(g, back[""] - 12)
        return total

    tokens = [b"thine!", b"Einst", b"zq\xc3\xa9-the", b"123", b"a", b"x" * 300]
    got = models.score_tokens(tokens)
    for t, row in zip(tokens, got):
        runs = letter_runs(t)
        assert row[-1] == sum(len(r) + 1 for r in runs)
        for k, lang in enumerate(models.langs):
            assert row[k] == pytest.approx(sum(score(r, *tables[lang]) for r in runs), rel=1e-4, abs=1e-3)
    points = np.frombuffer("abcab".encode("utf-32-le"), np.uint32)
    assert end_hashes(points, 2)[2][1] == end_hashes(points, 2)[2][4] == gram_hash(["ab"])[0]


def test_cache_does_not_change_scores(monkeypatch):
    import leadweave.llm.language_id as L

    models = CharModels({"x": counts("der die das"), "y": counts("the this that")})
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)).encode()
    full = Scorer(models).texts([text])[0]
    monkeypatch.setattr(L, "CACHE_TOKENS", 40)
    monkeypatch.setattr(L, "BATCH_TOKENS", 30)
    small = Scorer(models)
    for _ in range(2):
        assert np.allclose(small.texts([text, None, text])[2], full)


def test_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = op1_kneser_ney_language(spark, SMALL).join(lang, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 1


def test_rejects_and_edges(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    models = fit_documents(docs)
    strange = spark.createDataFrame([(1, "zxqj wvkx qqzz jjxw kkqz " * 40), (2, "привет мир это русский текст " * 20), (3, docs.first().text)], "doc_id long, text string")
    got = {r.id: r.rejected for r in identify(strange, models).collect()}
    assert got == {1: True, 2: True, 3: False}
    out = identify(odd, models).collect()
    assert len(out) == odd.count()
    texts = {r.doc_id: r.text for r in odd.filter("doc_id IS NOT NULL AND doc_id <> 7").collect()}
    for r in out:
        if r.id in texts and not any(c.isalpha() for c in texts[r.id] or ""):
            assert (r.lang_pred, r.score, r.rejected, r.cross_entropy) == ("und", 0.0, True, None)
    assert identify(empty, models).collect() == []
    nothing = fit_documents(empty)
    assert {r.lang_pred for r in identify(odd, nothing).collect()} == {"und"}
    assert drop_rejected(docs).columns == docs.columns and drop_rejected(docs).count() >= 0.995 * docs.filter(F.col("text").rlike(r"\p{L}")).count()


def test_junk_among_calibration_texts_does_not_move_the_limit():
    from leadweave.llm.language_id import _limits

    rng = np.random.default_rng(4)
    clean = [("de", float(b), 1500) for b in rng.normal(1.93, 0.06, 100)]

    def highest(seen):
        middle, between, within, limit = _limits(["de"], seen)[0]
        return middle + limit * math.sqrt(between**2 + within**2 / 300)

    alone = highest(clean)
    assert 2.5 < alone < 3.5
    for junk in (1, 10, 25):
        assert highest(clean + [("de", 5.0, 1500)] * junk) < alone + 0.4
    assert _limits(["de", "en"], clean)[1].tolist() == [3.0, 0.3, 2.5, 6.0]


def test_mislabelled_calibration_texts_are_left_out(spark, monkeypatch):
    import leadweave.llm.language_id as L

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = []
    limits = L._limits
    monkeypatch.setattr(L, "_limits", lambda langs, rows: seen.extend(rows) or limits(langs, rows))
    wrong = docs.filter("lang = 'en' AND n_chars > 300").limit(60).selectExpr("doc_id + 100000 AS doc_id", "text", "'de' AS lang")
    mixed = fit_documents(docs.select("doc_id", "text", "lang").unionByName(wrong))
    middle, between, _, limit = mixed.reject[mixed.langs.index("de")]
    assert middle + limit * between < 3 and max(b for x, b, _ in seen if x == "de") < 3
