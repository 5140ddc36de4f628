"""Structured Streaming versions of the batch operators.

Stateless column expressions run unchanged on a stream. Rows later than the watermark are
dropped by the windowed and deduplicating jobs; the per-key state machines take rows in
arrival order within a batch, sorted by time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed, html as H, text as X, urls as U
from ..operators.health import BREAKER_START, breaker_step
from ..session import shared_dir, stream_dir

LATENESS = "10 minutes"


def page_stream(pages: DataFrame) -> DataFrame:
    """Cleaned page records as pages arrive."""
    content = H.clean_content("html")
    return pages.select(
        "page_id", U.normalize_url("url").alias("url"), H.title("html").alias("title"), H.language("html").alias("language"),
        H.plain_text(content).alias("text"), F.size(H.main_links("html")).alias("links"))


def dedup_stream(rows: DataFrame, text: str, ts: str, lateness: str = LATENESS) -> DataFrame:
    """First row per content hash within the lateness bound, which also bounds the state."""
    return rows.withColumn("hash", X.content_hash(text)).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["hash"])


def endpoint_metrics(requests: DataFrame, lateness: str = LATENESS, every: str = "1 minute") -> DataFrame:
    """Calls, latency sum and successes per endpoint and minute."""
    return (
        requests.withWatermark("ts", lateness)
        .groupBy(F.window("ts", every), U.endpoint_key("method", "path").alias("endpoint"))
        .agg(F.count("*").alias("count"), F.sum("latency_ms").alias("latency_ms_sum"),
             F.count_if(F.col("status").between(200, 399)).alias("success_count"))
        .select(F.col("window.start").alias("minute"), "endpoint", "count", "latency_ms_sum", "success_count"))


def failure_rates(outcomes: DataFrame, lateness: str = LATENESS, size: str = "120 seconds", slide: str = "30 seconds") -> DataFrame:
    """Failure share per host in sliding windows."""
    return (
        outcomes.withWatermark("ts", lateness).groupBy(F.window("ts", size, slide), "host")
        .agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"))
        .select(F.col("window.start").alias("start"), "host", "calls", "failures", (F.col("failures") / F.col("calls")).alias("failure_rate")))


def _stateful(df: DataFrame, key: str, output: str, fn, timeout=GroupStateTimeout.NoTimeout) -> DataFrame:
    return df.groupBy(key).applyInPandasWithState(fn, output, "state string", "append", timeout)


def _load(state: GroupState, default):
    return json.loads(state.get[0]) if state.exists else default


def _batch(frames, order: list[str]) -> pd.DataFrame:
    parts = list(frames)
    rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    return rows.sort_values(order) if len(rows) else rows


def watch_changes(snapshots: DataFrame) -> DataFrame:
    """Changed flag and running change count of snapshots ``(url, ts, text)``.

    The hash is computed before the state, so only 64 characters per row reach Python.
    """
    hashed = snapshots.select("url", "ts", X.change_hash("text").alias("hash"))

    def step(key, frames, state):
        last = _load(state, {"hash": None, "n": 0, "at": None})
        out = []
        for url, ts, h in _batch(frames, ["ts", "hash"]).itertuples(index=False):
            changed = last["hash"] is not None and last["hash"] != h
            last = {"hash": h, "n": last["n"] + changed, "at": str(ts) if changed else last["at"]}
            out.append((url, ts, h, changed, last["n"]))
        state.update((json.dumps(last),))
        yield pd.DataFrame(out, columns=["url", "ts", "hash", "changed", "change_count"])

    return _stateful(hashed, "url", "url string, ts timestamp, hash string, changed boolean, change_count long", step)


def breaker(outcomes: DataFrame, threshold=fixed.FAILURE_THRESHOLD, recovery=fixed.RECOVERY_SECONDS,
            probes=fixed.HALF_OPEN_CALLS) -> DataFrame:
    """Live breaker over ``(host, call_id, start_ts, ts, ok)``: the transition of the batch replay."""
    advance = breaker_step(threshold, recovery, probes)
    moments = F.array(
        F.struct(F.lit(0).alias("kind"), F.unix_micros("start_ts").alias("event_us")),
        F.struct(F.lit(1).alias("kind"), F.unix_micros("ts").alias("event_us")))
    events = outcomes.select(F.col("host").cast("string").alias("host"), "call_id", "ok", F.explode(moments).alias("m")).select(
        "host", "call_id", "ok", "m.kind", "m.event_us")

    def step(key, frames, state):
        current, out = advance(_load(state, BREAKER_START), _batch(frames, ["event_us", "kind", "call_id"]).to_dict("records"))
        state.update((json.dumps(current),))
        cols = ["host", "call_id", "event_us", "kind", "admitted", "state", "since_us", "run"]
        if out:
            yield pd.DataFrame(out, columns=cols).astype({"since_us": "Int64"})

    return _stateful(events, "host",
                     "host string, call_id long, event_us long, kind string, admitted boolean, state string, since_us long, run long", step)


def rate_multipliers(outcomes: DataFrame) -> DataFrame:
    """Live adaptive multiplier after every outcome ``(host, id, ts, ok)``."""
    rows = outcomes.select(F.col("host").cast("string").alias("host"), "id", "ts", "ok")

    def step(key, frames, state):
        m = _load(state, fixed.MAX_MULTIPLIER)
        out = []
        for host, i, ts, ok in _batch(frames, ["ts", "id"]).itertuples(index=False):
            m = min(m + fixed.RECOVERY_STEP, fixed.MAX_MULTIPLIER) if ok else max(m * fixed.BACKOFF_FACTOR, fixed.MIN_MULTIPLIER)
            out.append((host, i, ts, m))
        state.update((json.dumps(m),))
        yield pd.DataFrame(out, columns=["host", "id", "ts", "multiplier"])

    return _stateful(rows, "host", "host string, id long, ts timestamp, multiplier double", step)


def expirations(entries: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """One row per entry ``(key, stored_at, ttl)`` whose time is up, in event time.

    State per key is its newest entry; a newer one replaces it. When the watermark passes
    the expiry, the entry is reported and its state is dropped.
    """
    marked = entries.withWatermark("stored_at", lateness)

    def step(key, frames, state):
        if state.hasTimedOut:
            expired = json.loads(state.get[0])
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "stored_us": [expired[0]], "expires_us": [expired[1]]})
            return
        rows = pd.concat(list(frames), ignore_index=True)
        rows["us"] = rows["stored_at"].astype("datetime64[us]").astype("int64")
        newest = rows.loc[rows["us"].idxmax()]
        entry = [int(newest["us"]), int(newest["us"] + float(newest["ttl"]) * 1e6)]
        if not state.exists or json.loads(state.get[0])[0] <= entry[0]:
            state.update((json.dumps(entry),))
        due = json.loads(state.get[0])[1] // 1000 + 1
        # an entry already past the watermark expires with the next one
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return _stateful(marked.select(F.col("key").cast("string").alias("key"), "stored_at", "ttl"), "key",
                     "key string, stored_us long, expires_us long", step, GroupStateTimeout.EventTimeTimeout)


# ---- running -----------------------------------------------------------------------------

def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into Parquet and read the result back."""
    import os

    spark = stream.sparkSession
    out = os.path.join(stream_dir(spark, name), "out")
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out)
         .option("checkpointLocation", stream_dir(spark, name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_keyed_table(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stream in update mode over all available input; the newest row of every key.

    A row is written whenever it changes, so the last windows are there without waiting for a watermark that nothing moves on. Every
    micro-batch has a folder of its own, which a repeated batch writes again.
    """
    import os

    spark = stream.sparkSession
    out = os.path.join(stream_dir(spark, name), "out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"_batch={epoch}"))

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", stream_dir(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    rows = spark.read.schema(f"{fields}, `_batch` long").parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns])


def dedup_to_table(rows: DataFrame, text: str, order: str, name: str) -> DataFrame:
    """First row per content hash of a whole stream, however far apart the copies are.

    A batch keeps its smallest row in ``order`` per hash and drops, by an anti join of hashes, what earlier batches have
    stored: there is no state to bound. A repeated batch looks at earlier ones alone and writes its folder again.
    """
    import os

    spark = rows.sparkSession
    out = os.path.join(stream_dir(spark, name), "out")
    hashed = rows.withColumn("hash", X.content_hash(text)).drop(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema.fields)
    stored = lambda: spark.read.schema(f"{fields}, `_batch` long").parquet(out)

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in hashed.columns if c != "hash"]
        firsts = batch.groupBy("hash").agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in rest], "hash")
        if epoch > 0:
            earlier = stored().filter(F.col("_batch") < epoch).select(F.col("hash").alias("_known"))
            firsts = firsts.join(earlier, F.col("hash").eqNullSafe(F.col("_known")), "left_anti")
        firsts.write.mode("overwrite").parquet(os.path.join(out, f"_batch={epoch}"))

    q = hashed.writeStream.foreachBatch(write).option("checkpointLocation", stream_dir(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stored().drop("_batch")


def write_ndjson(stream: DataFrame, path: str, checkpoint: str | None = None):
    """NDJSON sink: one line per document."""
    return (stream.writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint or stream_dir(stream.sparkSession, "ndjson"))
            .trigger(availableNow=True).start())


def for_each_page(stream: DataFrame, fn: Callable[[DataFrame, int], None]):
    """Hook on every micro-batch of finished pages."""
    return (stream.writeStream.foreachBatch(fn).option("checkpointLocation", stream_dir(stream.sparkSession, "hook"))
            .trigger(availableNow=True).start())


def progress(stream: DataFrame, error: str | None = None) -> DataFrame:
    """Running totals per micro-batch: (batch, completed, errors), written by ``foreachBatch``."""
    import os

    spark: SparkSession = stream.sparkSession
    out = os.path.join(shared_dir(spark), "streams", "progress-" + os.path.basename(stream_dir(spark, "p")))
    bad = F.col(error).isNotNull() if error else F.lit(False)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.agg(F.lit(epoch).alias("batch"), F.count_if(~bad).alias("completed"), F.count_if(bad).alias("errors")).write.mode("append").parquet(out)

    for_each_page(stream, write).awaitTermination()
    return spark.read.parquet(out)
