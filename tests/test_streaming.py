from datetime import datetime, timedelta

from graphloom.streaming import watch

T0 = datetime(2025, 1, 1)


def test_debounce_batch_and_stream_agree(spark, tmp_path):
    rows = [(T0, "a", False), (T0 + timedelta(seconds=1), "a", True), (T0 + timedelta(seconds=9), "a", False), (T0, "b", True), (T0, None, True)]
    df = spark.createDataFrame(rows, "ts timestamp, path string, deleted boolean")
    got = sorted((r["path"] or "", r["deleted"], r["events"]) for r in watch.debounce(df).collect())
    assert got == [("", True, 1), ("a", False, 1), ("a", True, 2), ("b", True, 1)]
    src = str(tmp_path / "in")
    df.write.parquet(src)
    q = watch.debounce(watch.read_events(spark, src), late="1 minute").writeStream.format("memory").queryName("bursts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["path"] or "", r["deleted"], r["events"]) for r in spark.table("bursts").collect()) == got


def test_refresh_batches_are_distinct(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("p", "a"), ("p", "a"), ("q", "a")], "project string, id string").write.parquet(src)
    seen = []
    q = watch.refresh_batches(spark.readStream.schema("project string, id string").parquet(src), lambda b, n: seen.append(b.count()), str(tmp_path / "c"), once=True)
    q.awaitTermination()
    assert sum(seen) == 2


def test_upsert_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, ingest_no long, name string, source_hash string, ts timestamp"
    for k, rows in enumerate([[("a", 1, "x", "h1", T0), ("b", 2, "y", None, T0)], [("a", 3, "z", "h1", T0), ("b", 4, "y", None, T0)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        q = watch.upsert_stream(spark.readStream.schema(schema).parquet(src), out, ["name"], str(tmp_path / "c"), once=True)
        q.awaitTermination()
    got = {r["id"]: (r["name"], r["change_count"]) for r in watch.latest_snapshot(spark, out, 99).collect()}
    assert got == {"a": ("z", 1), "b": ("y", 2)}
    # A later batch of one id rewrites one bucket only; what it supersedes can go.
    spark.createDataFrame([("c", 5, "w", "h", T0), (None, 6, "w", "h", T0)], schema).write.mode("append").parquet(src)
    watch.upsert_stream(spark.readStream.schema(schema).parquet(src), out, ["name"], str(tmp_path / "c"), once=True).awaitTermination()
    versions = {v: [b for b, n, _ in watch._versions(spark, out, 99) if n == v] for _, v, _ in watch._versions(spark, out, 99)}
    assert len(versions[max(versions)]) == 1
    before = {tuple(r) for r in watch.latest_snapshot(spark, out, 99).select("id", "name", "change_count").collect()}
    assert before == {("a", "z", 1), ("b", "y", 2), ("c", "w", 1)} and watch.drop_superseded(spark, out, 99) >= 2
    assert {tuple(r) for r in watch.latest_snapshot(spark, out, 99).select("id", "name", "change_count").collect()} == before
    assert watch.latest_snapshot(spark, str(tmp_path / "none"), 9) is None
