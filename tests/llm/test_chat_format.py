import itertools

import numpy as np
import pytest
import xxhash

from leadweave.llm.chat_format import ROLES, STATES, fit, format_chats, observe

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chats(spark):
    return spark.read.parquet(f"{SMALL}/conversations.parquet")


@pytest.fixture(scope="module")
def model(chats):
    return fit(chats.withColumnRenamed("conv_id", "conv"))


def test_markers():
    assert observe("User: hello?", True) == ((2, 1, 4, 1), "hello?")
    assert observe("<|assistant|> hi", False)[0][0] == 3 and observe("### Response", True)[0][0] == 3 and observe("[system] be kind", True)[1] == "be kind"
    assert observe("Note: no speaker", True) == ((0, 1, 5, 0), "Note: no speaker") and observe("", False)[0] == (0, 0, 0, 0)


def test_viterbi_against_all_paths(model):
    rng = np.random.default_rng(1)
    for _ in range(10):
        seen = [(int(rng.integers(4)), int(rng.integers(2)), int(rng.integers(10)), int(rng.integers(2))) for _ in range(4)]
        e = model.emissions(seen)
        score = lambda p: model.start[p[0]] + sum(e[i, s] for i, s in enumerate(p)) + sum(model.move[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(STATES), repeat=4), key=score)
        path, v = model.decode(seen)
        assert score(path) == pytest.approx(score(best)) and v.max() == pytest.approx(score(best))
        # a prefix decoded, then a matrix over the rest, gives the same scores
        assert (model.decode(seen[:2])[1][:, None] + model.matrix(seen[2:])).max(axis=0) == pytest.approx(v)


def test_recovers_roles(chats, model):
    rows = format_chats(chats, model).filter("segment = 0").collect()
    assert len(rows) == chats.count()
    assert sum(r.role == r.given_role for r in rows) / len(rows) > 0.9


def test_any_number_of_tasks(spark, chats, model):
    one_long = chats.selectExpr("conv_id % 2 AS conv_id", "conv_id * 10 + turn AS turn", "role", "text")
    got = []
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        for df in (chats, one_long):
            got.append(sorted(map(tuple, format_chats(df, model).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[2] == got[4] and got[1] == got[3] == got[5]


def test_speakers_within_a_record(spark, model):
    text = "System: be brief\nUser: how are you?\nAssistant: I am fine.\nReally fine.\nUser: good"
    df = spark.createDataFrame([(1, 0, None, text)], "conv_id long, turn long, role string, text string")
    rows = format_chats(df, model).orderBy("segment").collect()
    assert [r.role for r in rows] == ["system", "user", "assistant", "user"]
    assert "".join(r.rendered for r in rows) == "<|system|>\nbe brief\n<|user|>\nhow are you?\n<|assistant|>\nI am fine.\nReally fine.\n<|user|>\ngood\n"


def test_odd_rows(spark, model):
    rows = [(1, 0, "user", None), (1, 0, "user", ""), (None, 3, None, "x"), (None, None, "odd", "y"), (2, None, "user", "hello\n\nUser: z"), (2, None, "user", "hello\n\nUser: z"), (3, 5, "assistant", "long " * 20000)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, conv long")
    out = format_chats(df, model).collect()
    assert sum(r.segment == 0 for r in out) == len(rows) and {r.role for r in out} <= set(ROLES)
    assert format_chats(df.filter("false"), model).collect() == []
    assert fit(df.filter("false").select("conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "conv")).decode([(0, 1, 3, 0)])[0]


def brute(rows, model):
    """The records of each conversation in order, decoded at once over plain lists."""
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for conv, rs in groups.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[3] is not None, 0 if r[3] is None else (xxhash.xxh64_intdigest(r[3].encode(), 42) ^ 1 << 63)))
        seen = [(observe(line, i == 0), r, i) for r in rs for i, line in enumerate((r[3] or "").split("\n"))]
        path = model.decode([o[0] for o, _, _ in seen])[0]
        for state, ((_, bare), r, i) in zip(path, seen):
            if i == 0 or state < len(ROLES):
                out.append([conv, r[1], 0 if i == 0 else out[-1][2] + 1, ROLES[state % len(ROLES)], r[2], state < len(ROLES), bare])
            else:
                out[-1][6] += "\n" + bare
    return sorted(((*x, (f"<|{x[3]}|>\n" if x[5] else "") + x[6] + "\n") for x in out), key=str)


def test_whole_query_against_brute_force(spark, chats, model):
    some = chats.filter("conv_id % 3 = 0").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in some.collect()]
    hot = [(5, 7, "user", "User: the same line?\nand more")] * (len(rows) // 2)
    for given in (rows, rows + hot, [(1, k, "user", t) for k, (_, _, _, t) in enumerate(rows)]):
        df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(3)
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        try:
            assert sorted(map(tuple, format_chats(df, model).collect()), key=str) == brute(given, model)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_roles_of_held_out_conversations(chats):
    learned = fit(chats.filter("conv_id % 5 <> 0").withColumnRenamed("conv_id", "conv"))
    rows = format_chats(chats.filter("conv_id % 5 = 0"), learned).filter("segment = 0").collect()
    assert len(rows) > 100 and sum(r.role == r.given_role for r in rows) / len(rows) > 0.9
