from datetime import datetime

from trovework.streaming import feeds

FEED = "change_id long, change_type string, file_path string, old_path string, repository string, commit_sha string, changed_at timestamp, received_at timestamp"


def test_state_of_files_over_batches(spark, tmp_path):
    t = lambda d: datetime(2025, 2, d)
    first = [(1, "ADDED", "a", None, "r", "s", t(1), t(1)), (2, "ADDED", "b", None, "r", "s", t(1), t(1))]
    second = [(3, "DELETED", "a", None, "r", "s", t(3), t(3)), (4, "MODIFIED", "b", None, "r", "s", datetime(2025, 1, 1), t(3))]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, FEED).write.mode("append").parquet(str(tmp_path / "feed"))
        feed = spark.readStream.schema(FEED).parquet(str(tmp_path / "feed"))
        q = feeds.state_of_files(spark, feed, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(60)
        got = {r["path"]: r["alive"] for r in spark.read.parquet(str(tmp_path / f"out/version={n}")).collect()}
        assert got == ({"a": True, "b": True} if n == 0 else {"a": False, "b": True})


def test_equal_times_in_two_batches_end_as_in_one(spark, tmp_path):
    from trovework.operators.changes import last_state

    t = datetime(2025, 2, 1)
    rows = [(2, "DELETED", "a", None, "r", "s", t, t), (1, "ADDED", "a", None, "r", "s", t, t), (3, "ADDED", "b", None, "r", "s", t, t), (4, "DELETED", "b", None, "r", "s", t, t)]
    for row in rows:
        spark.createDataFrame([row], FEED).write.mode("append").parquet(str(tmp_path / "feed"))
        q = feeds.state_of_files(spark, spark.readStream.schema(FEED).parquet(str(tmp_path / "feed")), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(60)
    got = {r["path"]: r["alive"] for r in spark.read.parquet(str(tmp_path / "out/version=3")).collect()}
    assert got == {r["path"]: r["alive"] for r in last_state(spark.createDataFrame(rows, FEED)).collect()} == {"a": False, "b": False}


def test_usage_windows(spark, tmp_path):
    rows = [(1, 10, 0.5, datetime(2025, 2, 1, 1)), (1, 10, 0.5, datetime(2025, 2, 1, 1)), (2, 5, None, datetime(2025, 2, 1, 1, 30)), (3, 1, 0.1, datetime(2025, 2, 9))]
    schema = "usage_id long, input_tokens int, cost_estimate double, completed_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    s = feeds.usage_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["calls"], r["input_tokens"]) for r in spark.table("windows").collect()] == [(2, 15)]


def test_progress(spark):
    df = spark.createDataFrame([("cloning x",), ("Failed",)], "message string")
    assert [(r["stage"], r["terminal"]) for r in feeds.progress(df).collect()] == [("CLONING", False), ("FAILED", True)]
