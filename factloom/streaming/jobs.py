"""Structured Streaming jobs: incremental parsing, target states, run latency, token budgets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from factloom.operators import aggregate, ranked


BUCKETS = 64


class Store:
    """A keyed table in a folder, rewritten by hash bucket. Buckets are versions in folders of their own, and a manifest says which one of each
    counts, and up to which batch every writer has come. A batch writes its versions, then one new manifest by a rename: a job that dies
    before that has changed nothing, and one that runs a batch again finds it in the manifest. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        path = self._fs_path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def manifest(self) -> dict:
        """The last one: number, schema, writers (name -> last batch) and buckets (number -> folder)."""
        names = [x for x in self._listed("manifests") if x.endswith(".json")]
        if not names:
            return {"number": 0, "schema": None, "writers": {}, "buckets": {}}
        stream = self._fs.open(self._fs_path(f"{self.path}/manifests/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def swap(self, manifest: dict) -> None:
        """Makes a manifest the last one, in one step."""
        folder, name = f"{self.path}/manifests", f"{manifest['number']:012d}.json"
        made = self._fs_path(f"{folder}/_{uuid.uuid4().hex}")
        out = self._fs.create(made, True)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        target = self._fs_path(f"{folder}/{name}")
        if self._fs.exists(target) or not self._fs.rename(made, target):
            raise RuntimeError(f"another writer has made manifest {name}")

    def read(self, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        m = manifest or self.manifest()
        if m["schema"] is None:
            raise FileNotFoundError(f"no table in {self.path}")
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.path}/{folder}/_bucket={k}" for k, folder in sorted(m["buckets"].items()) if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, key: Sequence[str], writer: str, batch: int, order: Sequence[str] = (), buckets: int = BUCKETS) -> None:
        """Rows into the table, the last of a key wins: by ``order``, then the newer batch's, then the greatest by all columns. A batch that the writer has done is left alone."""
        now = self.manifest()
        if batch <= now["writers"].get(writer, -1):
            return
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        columns, folder = rows.columns, f"versions/{uuid.uuid4().hex}"
        new = rows.withColumns({"_new": F.lit(1), "_bucket": bucket})
        touched = {r[0] for r in new.select("_bucket").distinct().collect()}  # at most ``buckets`` numbers
        if now["schema"] is not None:
            new = new.unionByName(self.read(touched, now).withColumns({"_new": F.lit(0), "_bucket": bucket}))
        latest = ranked.top(new, list(key), [*(F.desc_nulls_last(c) for c in order), F.desc("_new"), *(F.desc_nulls_last(c) for c in columns)])
        latest.select(*columns, "_bucket").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        schema = now["schema"] or json.loads(rows.schema.json())
        self.swap({"number": now["number"] + 1, "schema": schema, "writers": now["writers"] | {writer: batch}, "buckets": now["buckets"] | {str(k): folder for k in touched}})

    def vacuum(self) -> None:
        """Deletes versions that the last manifest doesn't name, and older manifests. Not while a job writes or reads."""
        m = self.manifest()
        for x in self._listed("versions"):
            if f"versions/{x}" not in m["buckets"].values():
                self._fs.delete(self._fs_path(f"{self.path}/versions/{x}"), True)
        for x in self._listed("manifests")[:-1]:
            self._fs.delete(self._fs_path(f"{self.path}/manifests/{x}"), False)


def start_incremental_parse(captures: DataFrame, parse: Callable[[DataFrame], DataFrame], store: str, key: Sequence[str], checkpoint: str, order: Sequence[str] = (), buckets: int = BUCKETS):
    """Parses each micro-batch of captures and upserts the rows by key into the ``Store`` in a folder, the last writer wins.

    A batch reads and rewrites the buckets that its keys fall in, so its cost follows the batch. Batches are counted by ``checkpoint``: one that runs again,
    or died on the way, leaves the same rows as one that ran once.
    """

    def write(batch: DataFrame, n: int) -> None:
        Store(batch.sparkSession, store).upsert(parse(batch), key, checkpoint, n, order, buckets)

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rocks(df: DataFrame) -> None:
    """Typed state needs this provider; set for the session."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Targets(StatefulProcessor):
    """State of a target: newest time and state, attempts, newest error. The state of a finished target ends at a timer."""

    def __init__(self, final: Sequence[str], keep_ms: int | None):
        self.final, self.keep_ms = tuple(final), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.target = handle.getValueState("target", "ts long, state string, attempts int, error_ts long, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ts, state, attempts, error_ts, error = self.target.get() if self.target.exists() else (None, None, 0, None, None)
        for r in rows:
            attempts += r["state"] in ("cached", "failed")
            if ts is None or (r["us"], r["state"]) >= (ts, state):
                ts, state = r["us"], r["state"]
            if r["error"] is not None and (error_ts is None or (r["us"], r["error"]) >= (error_ts, error)):
                error_ts, error = r["us"], r["error"]
        self.target.update((ts, state, attempts, error_ts, error))
        if self.keep_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            if state in self.final:
                self.handle.registerTimer(ts // 1000 + self.keep_ms)
        yield Row(target_id=key[0], state=state, attempts=attempts, last_error=error)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.target.clear()
        return iter(())

    def close(self) -> None:
        pass


def track_targets(events: DataFrame, watermark: str | None = None, final: Sequence[str] = ("loaded", "inactive"), keep_seconds: int = 86_400) -> DataFrame:
    """events(target_id, ts, state, error) -> one row an update: (target_id, state, attempts, last_error); an older event changes nothing but the attempts.

    Events of one time count in the order of their state and error. With a ``watermark``, later events than it allows are dropped, and the state of a target
    whose newest state is ``final`` ends when the watermark is ``keep_seconds`` past it: a target that comes back begins anew. Without, all states stay.
    """
    _rocks(events)
    kind = events.schema["target_id"].dataType.simpleString()
    e = events.withWatermark("ts", watermark) if watermark else events
    rows = e.select("target_id", "ts", F.unix_micros("ts").alias("us"), "state", "error")
    return rows.groupBy("target_id").transformWithState(_Targets(final, keep_seconds * 1000 if watermark else None), f"target_id {kind}, state string, attempts int, last_error string", "Update", "EventTime" if watermark else "None")


def run_latency(events: DataFrame, slo_seconds: float, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """events(run_id, ts) -> (run_id, latency_s, stages, breach) of each session of a run; late events beyond the watermark are dropped on streams."""
    e = events.withWatermark("ts", watermark) if events.isStreaming else events
    per = e.groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(F.count("*").alias("stages"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    latency = (F.unix_micros("b") - F.unix_micros("a")) / 1e6
    return per.select("run_id", F.col("a").alias("started"), latency.alias("latency_s"), "stages", (latency > slo_seconds).alias("breach"))


def latency_rollup(runs: DataFrame, width: str = "1 day") -> DataFrame:
    """runs(started, latency_s, breach) -> (from, runs, p50, p95, breaches): median and 95th percentile of latency by tumbling window of the start.

    In batches by exact selection (``aggregate.quantiles``), so that no task holds a window's latencies; on streams by Spark's own percentile.
    """
    w = F.window("started", width)["start"]
    counts = [F.count("*").alias("runs"), F.count_if("breach").alias("breaches")]
    if runs.isStreaming:
        out = runs.groupBy(w.alias("from")).agg(*counts, F.percentile("latency_s", 0.5).alias("p50"), F.percentile("latency_s", 0.95).alias("p95"))
        return out.select("from", "runs", "p50", "p95", "breaches")
    r = runs.select(w.alias("from"), "latency_s", "breach")
    q = aggregate.quantiles(r, ["from"], "latency_s", [0.5, 0.95])
    wide = q.groupBy("from").agg(*(F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))))
    return r.groupBy("from").agg(*counts).join(wide, "from", "left").select("from", "runs", "p50", "p95", "breaches")


class _Calls(StatefulProcessor):
    """Calls of a run that wait for the watermark, in order of arrival; and what the released ones have used. All in one value with one timer, at the earliest
    waiting call, as each use of the state is a question to another process: a few a run and micro-batch, not a few a call."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "used long, ms array<long>, number array<long>, tokens array<long>, known array<boolean>")

    def _read(self) -> tuple[int, list]:
        used, *waiting = self.run.get() if self.run.exists() else (0, (), (), (), ())
        return used, list(zip(*waiting, strict=True))

    def _write(self, used: int, waiting: list) -> None:
        self.run.update((used, *([w[k] for w in waiting] for k in range(4))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        used, waiting = self._read()
        first = min((w[0] for w in waiting), default=None)
        waiting += [(r["ms"], r["call_number"], 0 if r["tokens"] is None else r["tokens"], r["tokens"] is not None) for r in rows]
        self._write(used, waiting)
        if first is None or min(w[0] for w in waiting) < first:
            self.handle.registerTimer(min(w[0] for w in waiting))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        used, waiting = self._read()
        left = [w for w in waiting if w[0] > now]
        out = []
        for _, number, tokens, known in sorted((w for w in waiting if w[0] <= now), key=lambda w: w[:2]):
            used += tokens
            out.append(Row(run_id=key[0], call_number=number, tokens=tokens if known else None, used=used, left=max(0, self.cap - used), over=used > self.cap))
        if out:
            self._write(used, left)
            if left:
                self.handle.registerTimer(min(w[0] for w in left))
        return iter(out)

    def close(self) -> None:
        pass


def running_budget(calls: DataFrame, cap: int, watermark: str = "10 minutes") -> DataFrame:
    """calls(run_id, call_number, tokens) -> each call with the running total, what is left, and whether it has broken the cap.

    On streams, calls(…, ts) wait until the watermark has passed them, and come out in the order of their time, those of one time by number; so calls may
    arrive in any order within the watermark, later ones are dropped. Runs number their calls in the order of time.
    """
    if calls.isStreaming:
        _rocks(calls)
        kind = calls.schema["run_id"].dataType.simpleString()
        c = calls.withWatermark("ts", watermark).select("run_id", F.col("call_number").cast("long").alias("call_number"), F.col("tokens").cast("long").alias("tokens"), "ts", F.unix_millis("ts").alias("ms"))
        return c.groupBy("run_id").transformWithState(_Calls(cap), f"run_id {kind}, call_number long, tokens long, used long, left long, over boolean", "Append", "EventTime")
    used = F.sum(F.coalesce("tokens", F.lit(0))).over(W.partitionBy("run_id").orderBy("call_number").rowsBetween(W.unboundedPreceding, W.currentRow))
    return calls.withColumn("used", used).withColumns({"left": F.greatest(F.lit(0), cap - F.col("used")), "over": F.col("used") > cap})
