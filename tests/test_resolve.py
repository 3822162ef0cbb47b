"""Cases of entity resolution."""

import pytest
from pyspark.sql import functions as F

from leadweave import schemas
from leadweave.operators import resolve


def records(spark, rows):
    base = {f.name: None for f in schemas.TABLES["raw_records"]}
    made = [tuple((base | {"rating": 0.0, "review_count": 0, "social_media_handles": [], "phone_metadata": []} | r).values()) for r in rows]
    return spark.createDataFrame(made, schemas.TABLES["raw_records"])


def entities(spark, rows):
    return {e["id"]: e for e in resolve.resolve(records(spark, rows)).collect()}


@pytest.mark.parametrize(
    "a, b, together",
    [
        ({"name": "Pharmacie Centrale", "website": "https://c.dz", "phone": "1"}, {"name": "Pharmacie Centrale", "website": "http://www.c.dz/", "phone": "1"}, True),
        ({"name": "Pharmacie Centrale", "website": "https://c.dz"}, {"name": "Garage Moderne", "website": "https://m.dz"}, False),
        ({"name": "Pharmacie Centrale"}, {"name": "Pharmacie Centrale"}, True),
        ({"name": "Pharmacie Centrale", "website": "https://c.dz"}, {"name": "Pharmacie Centrale", "website": "https://d.dz"}, False),
        ({"name": "Pharmacie Centrale", "website": "https://c.dz"}, {"name": "Pharmacie Centrale Oran", "website": "https://c.dz"}, True),
        ({"name": "Pharmacie Centrale", "website": "https://c.dz", "phone": "1"}, {"name": "Pharmacie Centrale", "website": "https://c.dz"}, True),
        ({"name": "é"}, {"name": "é"}, True),
    ],
)
def test_pairs(spark, a, b, together):
    got = entities(spark, [a | {"id": 1}, b | {"id": 2}])
    assert len(got) == (1 if together else 2)
    if together:
        assert got[1]["raw_record_ids"] == [1, 2] and got[1]["confidence"] == pytest.approx(0.9) and got[1]["strategy"] == "graph_merge"
    else:
        assert {e["strategy"] for e in got.values()} == {"single"} and {e["confidence"] for e in got.values()} == {1.0}


def test_chain_is_one_entity(spark):
    rows = [{"id": 1, "name": "abcdefgh"}, {"id": 2, "name": "abcdefgx"}, {"id": 3, "name": "abcdefyx"}]
    score = {(r.a, r.b): r.score for r in resolve.scored_pairs(records(spark, rows)).collect()}
    cfg = resolve.ResolverConfig(edge_threshold=0.64)
    assert score[1, 2] >= 0.64 and score[2, 3] >= 0.64 and score[1, 3] < 0.64
    got = resolve.resolve(records(spark, rows), cfg).collect()
    assert len(got) == 1 and got[0]["confidence"] == pytest.approx(0.99)


def test_large_blocks_are_not_compared(spark):
    assert len(entities(spark, [{"id": i, "name": "abc"} for i in range(101)])) == 101
    assert len(entities(spark, [{"id": i, "name": "abc"} for i in range(100)])) == 1
    assert resolve.resolve(records(spark, [])).collect() == []


def test_golden_record(spark):
    phone = {"original_string": "x", "e164": "+3", "international": "x", "national": "x", "phone_type": "MOBILE", "region": None, "carrier": None, "is_valid": True}
    rows = [
        {"id": 5, "name": "Pharmacie Centrale", "address": "short", "rating": 1.0, "social_media_handles": ["b", "a"], "wilaya": "W5"},
        {"id": 6, "name": "Pharmacie Centrale", "address": "a longer one", "rating": 3.0, "review_count": 4, "social_media_handles": ["a"], "phone": "+2", "phone_metadata": [phone], "wilaya": "W6", "industry": "i"},
        {"id": 7, "name": "Pharmacie Centrale", "address": "b longer one", "rating": 2.0},
    ]
    members = spark.createDataFrame([(5, 5), (6, 5), (7, 5)], "id long, cluster long")
    e = resolve.golden_records(records(spark, rows), members).first()
    assert (e["address"], e["rating"], e["review_count"], e["phones"], e["phone"], e["social_media_handles"], e["wilaya"], e["industry"], e["raw_record_ids"]) == ("a longer one", 3.0, 4, ["+2", "+3"], "+2", ["a", "b"], "W6", "i", [5, 6, 7])


def test_reasons(spark):
    r = resolve.scored_pairs(records(spark, [{"id": 1, "name": "Same Name", "website": "a.dz", "email": "A@b.c"}, {"id": 2, "name": "Same Name", "website": "https://a.dz", "email": "a@b.c "}])).first()
    assert r["reasons"] == ["name:1.00", "website:exact", "phone:0.50", "email:exact"]
    assert r["score"] == pytest.approx(0.9) and resolve.edges(records(spark, [])).filter(F.lit(True)).collect() == []
