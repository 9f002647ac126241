from __future__ import annotations

from glyphmill.streaming import events as E


def rows(df):
    return sorted(map(tuple, df.collect()))


def stream(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, data, folder):
    e = spark.read.parquet(f"{data}/events.parquet").where("event_id < 400").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")
    e.union(e.where("event_id % 5 = 0")).coalesce(1).write.parquet(folder)
    return e


def test_each_event_counts_once(spark, data, tmp_path):
    e = source(spark, data, str(tmp_path / "in"))
    out = stream(spark, E.once(E.read_events(spark, str(tmp_path / "in")), "60 days"), "once")
    assert out.count() == e.count()


def test_windows_of_stream_and_batch_agree(spark, data, tmp_path):
    source(spark, data, str(tmp_path / "in"))
    batch = spark.read.schema(E.EVENT).parquet(str(tmp_path / "in"))
    got = stream(spark, E.counted(E.read_events(spark, str(tmp_path / "in")), late="60 days"), "counted", "complete")
    assert rows(got.select("start", "event_type", "events")) == rows(E.counted(batch).select("start", "event_type", "events"))


def test_latest_state_survives_a_batch_given_twice(spark, data, tmp_path):
    e = source(spark, data, str(tmp_path / "in"))
    folder = str(tmp_path / "state")
    apply = E.upsert_latest(folder, buckets=4)
    want: dict = {}
    for r in sorted(e.collect(), key=lambda r: (r.ts, r.event_id)):
        want[r.user_id] = r.event_id
    assert E.latest_state(spark, folder).count() == 0
    for number, batch in ((0, e.where("event_id < 200")), (1, e.where("event_id >= 200 and event_id < 390")), (1, e.where("event_id >= 200 and event_id < 390")), (2, e.where("event_id >= 390")), (3, e.where("event_id = 399"))):
        apply(batch, number)
    assert {r.user_id: r.event_id for r in E.latest_state(spark, folder).collect()} == want
    versions = E._versions(spark, folder)
    # Only one bucket was touched by the last batch, and no bucket keeps more than three versions.
    assert sum(v[-1] == 3 for v in versions.values()) == 1 and max(map(len, versions.values())) <= 3


def test_quota_counts_over_batches(spark, data, tmp_path):
    e = source(spark, data, str(tmp_path / "in"))
    out = stream(spark, E.quota(E.read_events(spark, str(tmp_path / "in")), 5), "quota")
    by_user = e.union(e.where("event_id % 5 = 0")).groupBy("user_id").count().collect()
    got = {r.user_id: r for r in out.groupBy("user_id").agg({"used": "max"}).withColumnRenamed("max(used)", "used").collect()}
    assert {k: r.used for k, r in got.items()} == {r.user_id: r["count"] for r in by_user}
    assert out.where("allowed != (used <= 5)").count() == 0
