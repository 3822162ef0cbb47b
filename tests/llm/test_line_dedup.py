import re
from collections import defaultdict

import pytest

from leadweave.llm.line_dedup import Runs, dedup_lines, merge


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute(rows):
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)] = min(i, owner.get(key(line), i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or owner.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_against_brute_force(docs, odd, batches):
    for df in (docs, odd):
        out = [(r.id, r.n_lines, r.n_dropped, r.text) for r in dedup_lines(df, batches=batches).collect()]
        assert sorted(out, key=str) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_no_python(docs):
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_levels(spark):
    runs = Runs(2, fan_out=2)
    for k in range(5):
        runs.add(spark.range(k * 5, k * 5 + 8).selectExpr("id k1", "id k2", f"{k}L owner"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    owners = defaultdict(list)
    for run in runs.all():
        for r in run.plain.collect():
            owners[r.k1].append(r.owner)
    assert {k: v for k, v in owners.items()} == {k: [max(0, min(4, (k - 3) // 5))] for k in range(28)}


def test_empty(empty):
    assert dedup_lines(empty).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_merged_where_they_lie(spark):
    """One exchange, of the batch; none of a run, neither for the anti-joins nor for compaction; runs are not sorted again."""
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    runs = Runs(4, fan_out=3)
    for k in range(2):
        runs.add(spark.range(k * 50, k * 50 + 80).selectExpr("id k1", "id k2", "id owner"))
    batch = spark.range(20, 300).selectExpr("id k1", "id k2", "id owner")
    plan = plan_of(runs.new(batch))
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2 and plan.count("Sort [") == 1
    merged = merge(*[r.keys for r in runs.all()])
    assert "Exchange" not in plan_of(merged.hint("merge")) and "Sort [" not in plan_of(merged) and merged.count() == 130
