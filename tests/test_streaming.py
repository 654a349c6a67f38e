import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from factloom.streaming import jobs

SCHEMA = "target_id int, ts timestamp, state string, error string"
T = dt.datetime(2024, 1, 1)


def test_incremental_parse_upserts(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(src / "1"))
    stream = lambda: spark.readStream.schema("k int, v string").parquet(f"{src}/*")
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    parse = lambda df: df.withColumn("v", F.upper("v"))
    jobs.start_incremental_parse(stream(), parse, store, ["k"], check).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string").write.parquet(str(src / "2"))
    jobs.start_incremental_parse(stream(), parse, store, ["k"], check).awaitTermination()
    assert sorted(map(tuple, jobs.Store(spark, store).read().select("k", "v").collect())) == [(1, "A"), (2, "C"), (3, "D")]


def test_the_last_writer_wins_within_and_between_batches(spark, tmp_path):
    schema, src, store = "k int, t int, v string", tmp_path / "src", str(tmp_path / "store")
    batches = [[(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 5, "x")], [(1, 2, "late"), (2, 5, "again"), (None, 1, "n")], []]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(str(src / str(n)))
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        jobs.start_incremental_parse(stream, lambda b: b, store, ["k"], str(tmp_path / "check"), order=["t"], buckets=3).awaitTermination()
    got = sorted(map(tuple, jobs.Store(spark, store).read().select("k", "v").collect()), key=repr)
    assert got == [(1, "c"), (2, "again"), (None, "n")]


def test_a_job_that_dies_loses_no_row(spark, tmp_path, monkeypatch):
    """Dies between its new versions and the manifest, then while it writes them; runs again; and a batch that is done is not done twice."""
    schema, src, store = "k int, v string", tmp_path / "src", str(tmp_path / "store")
    run = lambda: jobs.start_incremental_parse(spark.readStream.schema(schema).parquet(f"{src}/*"), lambda b: b, store, ["k"], str(tmp_path / "check"), buckets=2).awaitTermination()
    rows = lambda: sorted(map(tuple, jobs.Store(spark, store).read().collect()))
    spark.createDataFrame([(k, "old") for k in range(10)], schema).write.parquet(str(src / "0"))
    run()
    before = rows()
    spark.createDataFrame([(3, "new"), (20, "new")], schema).write.parquet(str(src / "1"))
    whole = jobs.Store.swap

    def dies(self, manifest):
        raise OSError("killed")

    monkeypatch.setattr(jobs.Store, "swap", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    assert rows() == before
    monkeypatch.setattr(jobs.Store, "swap", whole)
    (tmp_path / "store" / "versions" / "half" / "_bucket=0" / "_temporary").mkdir(parents=True)
    run()
    want = sorted([(k, "new" if k == 3 else "old") for k in range(10)] + [(20, "new")])
    assert rows() == want
    s = jobs.Store(spark, store)
    number = s.manifest()["number"]
    s.upsert(spark.createDataFrame([(99, "twice")], schema), ["k"], str(tmp_path / "check"), 1)
    assert rows() == want and s.manifest()["number"] == number
    s.vacuum()
    assert rows() == want and len(list((tmp_path / "store" / "versions").iterdir())) <= 2
    with pytest.raises(RuntimeError, match="another writer"):
        s.swap(s.manifest())


def fed(spark, tmp_path, build, batches, schema, mode):
    """Rows that a stream gives for batches of input, with the batch they came in."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03d}"))
        os.utime(tmp_path / "in" / f"{n:03d}", (n + 1, n + 1))
        for f in (tmp_path / "in" / f"{n:03d}").iterdir():
            os.utime(f, (1_000_000 + n, 1_000_000 + n))
    out = []

    def keep(batch, n):
        out.extend((n, *r) for r in batch.collect())

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    build(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return out


def test_finished_targets_end(spark, tmp_path):
    day = lambda n: T + dt.timedelta(n)
    batches = [[(1, day(0), "failed", "x"), (1, day(1), "loaded", None), (2, day(0), "cached", None)], [(3, day(10), "pending", None)], [(3, day(11), "cached", None)], [(1, day(12), "cached", None), (2, day(12), "cached", None), (2, day(2), "failed", "late")]]
    got = fed(spark, tmp_path, lambda s: jobs.track_targets(s, "1 day", keep_seconds=3600), batches, SCHEMA, "update")
    last = {}
    for _, *r in got:
        last[r[0]] = tuple(r[1:])
    # Target 1 was finished, so its attempts and error are gone; target 2's late failure is dropped.
    assert last == {1: ("cached", 1, None), 2: ("cached", 2, None), 3: ("cached", 1, None)}


def test_running_budget_of_a_stream_out_of_order(spark, tmp_path):
    at = lambda s: T + dt.timedelta(seconds=s)
    batches = [[(1, 2, 50, at(20)), (1, 1, 60, at(10)), (2, 1, None, at(15))], [(1, 4, 5, at(40)), (1, 3, 1, at(30)), (2, 2, 200, at(31))], [(9, 1, 0, at(10_000))], [(9, 2, 0, at(10_001))], [(9, 3, 0, at(10_002)), (1, 5, 7, at(50))]]
    got = fed(spark, tmp_path, lambda s: jobs.running_budget(s, 100, "1 minute"), batches, "run_id int, call_number int, tokens long, ts timestamp", "append")
    rows = [r[1:] for r in got if r[1] != 9]
    assert [r for r in rows if r[0] == 1] == [(1, 1, 60, 60, 40, False), (1, 2, 50, 110, 0, True), (1, 3, 1, 111, 0, True), (1, 4, 5, 116, 0, True)]  # the fifth call is too late
    assert [r for r in rows if r[0] == 2] == [(2, 1, None, 0, 100, False), (2, 2, 200, 200, 0, True)]


def test_track_targets(spark, tmp_path):
    rows = [(1, T, "pending", None), (1, T + dt.timedelta(1), "failed", "x"), (2, T, "loaded", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    q = jobs.track_targets(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("targets").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("targets").collect())) == [(1, "failed", 1, "x"), (2, "loaded", 0, None)]


def test_latency_and_budget(spark):
    e = spark.createDataFrame([(1, T), (1, T + dt.timedelta(seconds=20)), (1, T + dt.timedelta(hours=2))], "run_id int, ts timestamp")
    assert sorted((r["latency_s"], r["breach"]) for r in jobs.run_latency(e, 15).collect()) == [(0.0, False), (20.0, True)]
    c = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, None)], "run_id int, call_number int, tokens long")
    assert [(r["used"], r["left"], r["over"]) for r in jobs.running_budget(c, 100).orderBy("call_number").collect()] == [(60, 40, False), (110, 0, True), (110, 0, True)]


def test_a_run_asks_for_its_state_once_a_batch():
    """Each call asked for its place, wrote it and set a timer; each timer read all that waited."""
    from unittest.mock import MagicMock

    handle = MagicMock()
    handle.getMapState.return_value.containsKey.return_value = False
    handle.getValueState.return_value.exists.return_value = False
    calls = jobs._Calls(100)
    calls.init(handle)
    assert list(calls.handleInputRows((1,), iter([{"call_number": k, "ms": 1000 - k, "tokens": 5} for k in range(50)]), None)) == []
    assert handle.registerTimer.call_count == 1 and handle.getValueState.return_value.update.call_count == 1
    state, times = handle.getValueState.return_value, MagicMock()
    state.exists.return_value, state.get.return_value = True, state.update.call_args[0][0]
    times.getCurrentWatermarkInMs.return_value, times.getExpiryTimeInMs.return_value = 980, 951
    out = list(calls.handleExpiredTimer((1,), times, times))
    assert [r["call_number"] for r in out] == list(range(49, 19, -1)) and out[-1]["used"] == 150 and out[-1]["over"]
    assert handle.registerTimer.call_args[0] == (981,) and len(state.update.call_args[0][0][1]) == 20
