import datetime as dt

import pytest

from codexlake.streaming import feeds, queue


def test_transitions():
    s = queue.fresh(0.3)
    assert queue.complete(s, 0.3, "cooldown 5s")["attempts"] == 0
    assert queue.complete(s, 0.5)["status"] == "done"
    one = queue.complete(s, 0.31)
    assert (one["status"], one["strategy_level"], one["priority"]) == ("pending", 1, pytest.approx(0.345))
    three = queue.complete(queue.complete(one, 0.31), 0.31)
    assert three["status"] == "done" and three["strategy_level"] == 4 and three["last_error"].startswith("set aside")
    again = queue.enqueue(three, 2.0, 0, 4, 0.3)
    assert again["status"] == "pending" and again["attempts"] == 0
    assert queue.complete(again, 0.31)["last_error"].startswith("given up")
    assert queue.enqueue(s, 0.5, 0, 0, 0.3)["priority"] == 1.0 and queue.enqueue(None, 0.5, 2, 1, 0.3)["difficulty"] == 2


def events(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(minutes=i), i, c, e) for i, (c, e) in enumerate([(0.01, None), (0.01, None), (0.9, None)])] + [("b", t, 9, 0.0, "cooldown: x")]
    return spark.createDataFrame(rows, "ref_id string, ts timestamp, event_id long, completeness double, error string")


def test_replay_equals_stream(spark, tmp_path):
    e = events(spark)
    want = {r.ref_id: r for r in queue.replay(e).collect()}
    assert want["a"].status == "done" and want["a"].attempts == 3 and want["b"].attempts == 0
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = queue.stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {r.ref_id: r for r in spark.table("states").collect()} == want
    finally:
        q.stop()


def test_feed_upserts_versions(spark, tmp_path):
    t = feeds.VersionedTable(spark, f"file://{tmp_path}/t")
    cols = "id string, title string, batch_seq int"
    t.apply(spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], cols), 1)
    t.apply(spark.createDataFrame([("1", "c", 1), ("3", "d", 1)], cols), 2)
    t.apply(spark.createDataFrame([("1", "old", 1)], cols), 2)  # a repeated batch changes nothing
    assert {r.id: r.title for r in t.read().collect()} == {"1": "c", "2": "b", "3": "d"} and t.versions() == [1, 2]
    spark.createDataFrame([("4", "e", 1)], cols).write.parquet(f"{tmp_path}/changes")
    s = feeds.follow(spark.readStream.schema(cols).parquet(f"{tmp_path}/changes"), feeds.VersionedTable(spark, f"file://{tmp_path}/u"), f"{tmp_path}/cp")
    s.awaitTermination(60)
    assert feeds.VersionedTable(spark, f"file://{tmp_path}/u").read().first().id == "4"


def test_rates_and_caches(spark):
    t = dt.datetime(2024, 1, 1)
    calls = spark.createDataFrame([("x", t + dt.timedelta(seconds=20 * i)) for i in range(5)], "api string, ts timestamp")
    assert [r.allowed for r in feeds.within_limits(calls, {"minute": 3}).orderBy("ts").collect()] == [True, True, True, False, False]
    led = spark.createDataFrame([("r", "x", "h1", "miss", 1)], "ref_id string, api string, hash string, outcome string, ts int")
    ask = spark.createDataFrame([("r", "x", "h1"), ("r", "x", "h2")], "ref_id string, api string, hash string")
    assert [r.hash for r in feeds.untried(ask, led).collect()] == ["h2"]
    pools = spark.createDataFrame([("a", 5, 100), ("b", 4, 10), ("c", 0, 1)], "backend string, remaining int, allowance int")
    assert feeds.next_backend(pools).first().backend == "b"
    cache = spark.createDataFrame([("k", t, 1), ("k", t + dt.timedelta(days=1), 2), ("z", t - dt.timedelta(days=30), 3)], "key string, ts timestamp, v int")
    assert [(r.key, r.v) for r in feeds.live_cache(cache, "2024-01-02").collect()] == [("k", 2)]
    assert feeds.cycle([("ok", lambda: pools), ("bad", lambda: 1 / 0)])[1][1].startswith("ZeroDivisionError")


def test_dequeue(spark):
    q = spark.createDataFrame([("a", "pending", 0, 1.0, 0.7), ("b", "pending", 0, 9.0, 0.1), ("c", "active", 0, 5.0, 0.1)], "ref_id string, status string, strategy_level int, priority double, completeness_before double")
    refs = spark.createDataFrame([(x, "10.1/" + x, None, None, None, None, None) for x in "abc"], "id string, doi string, pmid string, arxiv_id string, isbn string, url string, year int")
    assert [r.ref_id for r in queue.dequeue(q, refs, 1, 5).collect()] == ["a", "b"]
