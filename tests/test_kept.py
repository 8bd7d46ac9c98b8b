"""Things that are kept: ranks, the passage index, restore points, views, timers, exchanged pages."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codexlake.operators import relational
from codexlake.operators.fulltext import PassageIndex, passage_search, word_passages
from codexlake.sources import exchange
from codexlake.sources.library import Library
from codexlake.sources.manifest import Conflict, Manifest
from codexlake.streaming import timers
from codexlake.streaming.feeds import VersionedTable
from codexlake.streaming.views import KeptCounts


def test_ranks_of_many_rows_with_a_payload(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 300_000
        df = spark.range(n).select((F.xxhash64("id") % 1000).alias("k"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        got = relational.ranked(df, ["k", "id"]).cache()
        assert got.count() == n == got.select("rank").distinct().count() and got.agg(F.min("rank"), F.max("rank")).first() == (1, n)
        assert got.alias("a").join(got.alias("b"), F.expr("a.rank + 1 = b.rank")).filter("struct(a.k, a.id) >= struct(b.k, b.id)").count() == 0
        chunks = relational.chunked(df, ["k", "id"]).groupBy("chunk").count()
        assert chunks.count() == n // 100 and chunks.filter("count <> 100").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- index ----------------------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(300)]


def texts(spark, seed, refs, tag=""):
    rng = random.Random(seed)
    rows = [(r, " ".join(tag + rng.choice(WORDS[: rng.choice([5, 40, 300])]) for _ in range(rng.randrange(0, 60)))) for r in refs]
    return word_passages(spark.createDataFrame(rows, "id string, text string"), "id", "text", 20)


def plain(df):
    return sorted((r.qid, r.ref_id, r.ord, round(r.score, 9)) for r in df.collect())


def asked(spark, *queries):
    return spark.createDataFrame([(i, w) for i, q in enumerate(queries) for w in q.split()], "qid int, term string")


def test_index_follows_changes_and_compacts(spark, tmp_path):
    all_of = [f"r{i:03d}" for i in range(200)]
    index = PassageIndex(spark, f"file://{tmp_path}/i", buckets=8)
    index.upsert(texts(spark, 1, all_of))
    index.upsert(texts(spark, 2, all_of[:40] + ["new"]), removed=spark.createDataFrame([(r,) for r in all_of[:40]], "ref_id string"))  # some have no words any more
    index.remove(spark.createDataFrame([(r,) for r in all_of[30:60]] + [("absent",)], "ref_id string"))
    fresh = PassageIndex(spark, f"file://{tmp_path}/f", buckets=8)
    keep = texts(spark, 1, all_of).filter(F.col("ref_id") >= "r060").unionByName(texts(spark, 2, all_of[:40] + ["new"]).filter((F.col("ref_id") < "r030") | (F.col("ref_id") == "new")))
    fresh.upsert(keep)
    q = asked(spark, "w1 w2 w250", "w3 w3 nothing", "nothing")
    want = plain(fresh.scores(q))
    assert want and plain(index.scores(q)) == want
    assert index.compact() > 0 and len(index._state()[1]["segments"]) == 1 and plain(index.scores(q)) == want
    one, two = index._state()[1]["segments"][0], fresh._state()[1]["segments"][0]
    assert (one["passages"], one["length"]) == (two["passages"], two["length"])
    top = [(r.qid, r.rank, r.ref_id, r.ord) for r in index.top(q, 7).orderBy("qid", "rank").collect()]
    by_score = sorted(want, key=lambda r: (r[0], -r[3], r[1], r[2]))
    assert top == [(q_, i + 1, ref, o) for q_ in (0, 1) for i, (_, ref, o, _) in enumerate([r for r in by_score if r[0] == q_][:7])]
    assert index.texts(index.top(q, 1)).filter(~F.contains("text", F.lit("w"))).count() == 0
    assert passage_search(index, q, n=3, per_ref=1, within=spark.createDataFrame([("r100",), ("r101",)], "ref_id string")).filter("ref_id NOT IN ('r100', 'r101')").count() == 0


def test_search_leaves_windows_unread_and_reads_its_buckets_only(spark, tmp_path):
    index = PassageIndex(spark, f"file://{tmp_path}/i", buckets=16)
    # a frequent word in every window, once in long passages; in one window it stands often in short ones
    rows = spark.range(30_000).select(F.col("id").cast("string").alias("ref_id"), F.lit(0).alias("ord"), F.when(F.col("id").between(12_000, 12_020), "rare rare rare").otherwise(F.concat(F.lit("rare "), F.repeat(F.lit("filler "), 30))).alias("text"))
    index.upsert(rows.coalesce(1))
    q = asked(spark, "rare")
    read, there = index.windows_scored(q, 10)
    assert there >= 14 and read <= there // 2
    found = index.top(q, 10).collect()
    assert len(found) == 10 and all(12_000 <= int(r.ref_id) <= 12_020 for r in found)
    plan = index._plan(q)[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)


def test_empty_index(spark, tmp_path):
    index = PassageIndex(spark, f"file://{tmp_path}/i")
    q = asked(spark, "w1")
    assert index.scores(q).count() == 0 if index.manifest.newest()[0] else True
    index.upsert(texts(spark, 1, []))
    assert index.scores(q).count() == index.top(q, 3).count() == 0
    index.upsert(spark.createDataFrame([("a", 0, "w1 " * 3), ("a", 1, ""), ("b", 0, None)], "ref_id string, ord int, text string"))
    assert [(r.ref_id, r.ord) for r in index.top(q, 3).collect()] == [("a", 0)]


# ---- manifests, restore points, views -------------------------------------------------------------------------------


def test_a_torn_commit_is_passed_over(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/l")
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    library.commit({"refs": one, "bridge": one})
    library.mark("before")
    library.commit({"refs": one.limit(0), "archive": one})
    (tmp_path / "l" / "manifest" / "00000099.json").write_text('{"tables": {"refs"')
    one.write.parquet(f"{tmp_path}/l/refs-lost")
    assert library.read("refs").count() == 0 and library.read("archive").count() == 1 and library.unnamed() == ["refs-lost"]
    assert library.points() == [(2, "before")]
    library.restore("before")
    assert sorted(library.tables()) == ["bridge", "refs"] and library.read("refs").collect() == one.collect()
    with pytest.raises(ValueError):
        library.restore("never")
    other = Manifest(spark, f"file://{tmp_path}/l/manifest")
    with pytest.raises(Conflict):
        other.commit({}, after=2)


def test_views_equal_the_recount_after_any_versions(spark, tmp_path):
    rng = random.Random(5)
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    view = KeptCounts(t, f"file://{tmp_path}/v", {"g": F.col("g")}, {"x": F.col("x")}, where=F.col("g") != "hidden")
    rows, cols = {}, "id int, g string, x double, batch_seq int"
    for step in range(5):
        batch = {rng.randrange(40): (rng.choice(["a", "b", None, "hidden"]), rng.choice([None, 0.1, 2.5])) for _ in range(15)}
        gone = [k for k in range(40) if rng.random() < 0.1]
        rows = {k: v for k, v in (rows | batch).items() if step == 0 or k not in gone}
        t.apply(spark.createDataFrame([(k, g, x, 1) for k, (g, x) in batch.items()], cols), removed=spark.createDataFrame([(k,) for k in gone], "id int") if step else None, log=step != 3)
        version, read = view.refresh()
        assert version == step + 1 and read == (0 if step in (0, 3) else 1)
        want = {}
        for g, x in rows.values():
            if g not in (None, "hidden"):
                n, s, m = want.get(g, (0, 0.0, 0))
                want[g] = n + 1, s + (x or 0.0), m + (x is not None)
        got = {r.g: (r.n, r.sum_x, r.avg_x) for r in view.read().collect()}
        assert set(got) == set(want)
        for g, (n, s, m) in want.items():
            assert got[g][0] == n and (m == 0 and got[g][1] is None or float(got[g][1]) == pytest.approx(s) and got[g][2] == pytest.approx(s / m))
    assert view.refresh() == (5, 0)


# ---- time -----------------------------------------------------------------------------------------------------------


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).json(str(path))


def until(check, seconds=60):
    end = time.time() + seconds
    while not check():
        assert time.time() < end
        time.sleep(0.3)


def test_time_alone_gives_a_lease_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = stream_of(spark, tmp_path / "in", "key string, at timestamp, number long, what string")
    writer = timers.lapses(rows, timers.Leases(seconds=2, clock=True)).writeStream.format("memory").queryName("lapsed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds")
    query = timers.started(spark, writer)
    try:
        (tmp_path / "in" / "a.json").write_text('{"key": "a", "at": "2024-01-01T00:00:00", "number": 1, "what": "take"}\n{"key": "b", "at": "2024-01-01T00:00:00", "number": 2, "what": "take"}\n{"key": "b", "at": "2024-01-01T00:00:01", "number": 3, "what": "done"}\n')
        until(lambda: spark.table("lapsed").count() > 0)  # no further row arrives
        time.sleep(2)
        assert [r.key for r in spark.table("lapsed").collect()] == ["a"]
    finally:
        query.stop()


def test_answers_die(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = stream_of(spark, tmp_path / "in", "key string, at timestamp, number long, value string")
    writer = timers.answered(rows, timers.Answers(seconds=6)).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds")
    query = timers.started(spark, writer)
    ask = lambda number: (tmp_path / "in" / f"{number}.json").write_text(f'{{"key": "k", "at": "2024-01-02T00:00:00", "number": {number}}}\n')
    try:
        (tmp_path / "in" / "put.json").write_text('{"key": "k", "at": "2024-01-01T00:00:00", "number": 0, "value": "answer"}\n{"key": "k", "at": "2024-01-02T00:00:00", "number": 1}\n')
        until(lambda: spark.table("answers").count() == 1)
        time.sleep(7)
        ask(2)
        until(lambda: spark.table("answers").count() == 2)
        assert {r.number: r.value for r in spark.table("answers").collect()} == {1: "answer", 2: None}
    finally:
        query.stop()


def test_lapses_do_not_depend_on_batches(spark, tmp_path):
    """A log in one batch and in many gives the same moments; the last ones come when the watermark has passed them."""
    rng, t = random.Random(3), dt.datetime(2024, 1, 1)
    events = []
    for number in range(120):
        t += dt.timedelta(seconds=rng.choice([20, 100, 700]))
        events.append((rng.choice("abc"), t, number, rng.choice(["take", "done", "error"])))
    cols, folders = "key string, at timestamp, number long, what string", (tmp_path / "one", tmp_path / "many")
    spark.createDataFrame(events, cols).coalesce(1).write.parquet(str(folders[0]))
    for i in range(0, 120, 30):
        spark.createDataFrame(events[i : i + 30], cols).coalesce(1).write.mode("append").parquet(str(folders[1]))
        time.sleep(1.1)  # files are taken in the order of their times
    results = []
    for folder, options in zip(folders, ({}, {"maxFilesPerTrigger": "1"})):
        rows = spark.readStream.schema(cols).options(**options).parquet(str(folder))
        out = timers.replayed(timers.lapses(rows, timers.Cooldowns()), f"file://{tmp_path}/out-{folder.name}")
        results.append(sorted((r.key, r.at) for r in out.collect()))
    due, errors, want = {}, {}, []
    for key, at, _, what in events:
        if key in due and at >= due[key]:
            want.append((key, due.pop(key)))
        if what == "error":
            errors[key] = errors.get(key, 0) + 1
            due[key] = max(due.get(key, at), at + timers.backoff(errors[key]))
        else:
            errors[key] = 0
    want += [(k, d) for k, d in due.items() if d <= t]
    assert results[0] == results[1] == sorted(want) and want


# ---- exchange -------------------------------------------------------------------------------------------------------


def test_a_filter_on_the_version_reads_fewer_pages(spark, tmp_path):
    exchange.register(spark)
    path = f"file://{tmp_path}/x"
    rows = spark.range(1000).select(F.col("id").alias("version"), F.concat(F.lit("t"), "id").alias("title"))
    push = lambda df, name: df.repartitionByRange(2, "version").sortWithinPartitions("version").write.format("page_exchange").options(path=path, push=name, page_rows="100").mode("append").save()
    push(rows, "first")
    push(rows, "first")  # tried again: nothing is added
    pull = spark.read.format("page_exchange").schema("version long, title string").option("path", path).load()
    assert pull.count() == 1000 and pull.rdd.getNumPartitions() >= 10
    since = pull.filter("version > 850")
    assert since.count() == 149 and since.rdd.getNumPartitions() <= 3
    push(rows.limit(0), "none")
    assert pull.filter("version IN (5, 7)").count() == 2 and pull.filter("version = 5000").count() == 0


def test_a_repeated_epoch_and_a_lost_task_push_once(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"version": i, "v": str(i)} for i in range(25)])
    writer = exchange.PushStream({"path": str(tmp_path), "page_rows": "10"})
    lost, whole = writer.write(iter([batch])), writer.write(iter([batch]))  # the first attempt's task is lost after it has written
    writer.commit([whole], 0)
    again = writer.write(iter([batch]))
    writer.commit([again, None], 0)
    service = exchange.Service(str(tmp_path))
    assert sum(p["rows"] for p in service.get_commits()) == 25
    assert not any((tmp_path / p["name"]).exists() for p in again.pages) and all((tmp_path / p["name"]).exists() for p in whole.pages)
    writer.abort([lost, None], 1)
    assert not any((tmp_path / p["name"]).exists() for p in lost.pages)
