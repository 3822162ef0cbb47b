"""Event-time operators as streams give what they give as batches."""

from pyspark.sql import functions as F

from leadweave.streaming import events as E

SF = "/root/testdata/sf0.001"


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def test_windows(spark, tmp_path):
    batch, s = stream(spark, tmp_path)
    got = {tuple(r) for r in run(spark, E.windowed(s, late="1 hour"), "w", "append").collect()}
    all_ = {tuple(r) for r in E.windowed(batch, late=None).collect()}
    assert got and got <= all_ and len(all_) - len(got) <= 10  # the last windows stay open
    assert E.windowed(batch, "1 day", "12 hours", None).agg(F.sum("n")).first()[0] == 2 * batch.count()


def test_deduplication(spark, tmp_path):
    batch, s = stream(spark, tmp_path)
    assert run(spark, E.deduplicated(s, ["event_id"]), "d", "append").count() == batch.select("event_id").distinct().count()


def test_keyed_state(spark, tmp_path):
    batch, s = stream(spark, tmp_path)
    got = {r.user_id: (r.fails, r.status) for r in run(spark, E.failure_state(s), "k", "update").collect()}
    expect = {}
    for r in batch.orderBy("ts", "event_id").collect():
        n = expect.get(r.user_id, (0, ""))[0]
        n = n + 1 if r.event_type == "error" else 0
        expect[r.user_id] = (n, "completed" if n == 0 else "failed" if n >= 5 else "pending")
    assert got == expect
