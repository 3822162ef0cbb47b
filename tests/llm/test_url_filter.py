import random
import re

import pytest
from pyspark.sql import functions as F

from leadweave.llm.url_filter import RULES, Rule, ShiftAnd, judge_urls


def brute(url):
    rest = (url or "").partition("://")[2]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match("[^?#]*", rest[len(host) :])[0]
    best = None
    for r in RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best.name if best else None, best.verdict if best else "allow"


ODD = [None, "", "no scheme/com/en/", "http://com/en/", "http://a.COM/en/x?y", "https://example.com/en/75", "https://xexample.com/en/75", "http://a.example.com/EN/7", "http://b.org/x.com/en/1", "http://net/de", "ftp://q.net/de/?a://b", "x://example.net/de/8#z", "http://org", "http://org?es/", "http://ünï.org/es/é", "a://b://c.com/en/", "http://com:80/en/", "http://x.com/en/\nq", "http://.com/en/"]


def test_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    df = pages.unionByName(spark.createDataFrame([(None if i == 3 else 7, u) for i, u in enumerate(ODD)], "page_id long, url string")).withColumns({c: F.lit(1) for c in ("id", "host", "rule")})
    got = sorted(((r.id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()), key=str)
    assert got == sorted(((r.page_id, *brute(r.url)) for r in df.collect()), key=str)
    assert judge_urls(df.filter("false")).collect() == []


def test_automaton_against_regex():
    rng = random.Random(8)
    globs = set()
    while len(globs) < 60:
        g = "".join(rng.choice("ab/*~") for _ in range(rng.randrange(1, 9)))
        if not re.search("[*~]{2}", g):
            globs.add(g)
    globs = sorted(globs)
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randrange(12))).encode() for _ in range(400)] + [b"a" * 300]
    auto = ShiftAnd(globs)
    assert auto.words > 2
    got = auto.matches(texts)
    for k, g in enumerate(globs):
        rx = re.compile(g.replace("*", "(?s:.)*").replace("~", "[^/]*").encode())
        assert got[:, k].tolist() == [bool(rx.fullmatch(t)) for t in texts]
    with pytest.raises(ValueError):
        ShiftAnd(["a**"])


def test_other_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (2, "http://z/")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(df, rules=[Rule("allow", "b/")], otherwise="block").orderBy("id").collect()] == ["allow", "block"]
    assert [r.rule for r in judge_urls(df, rules=[]).collect()] == [None, None]
