"""Host health from ordered outcome logs ``(host, ts, ok, ...)``.

Affine folds (rate multiplier, moving averages) compose: rows become small functions, which are
composed piece by piece over ranges of (key, time), by one plan at every size. State machines (breaker, token bucket)
use the segment-wise ``fold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed
from .segments import HOUR, SEG, compose, failures_in_a_row, fold, halo, ranked, top_k


def consecutive_failures(outcomes: DataFrame, host="host", ts="ts", ok="ok", ties=None) -> DataFrame:
    """Failures since the last success at every row."""
    return failures_in_a_row(outcomes, [host], ts, ok, ties)


def recent_failure_rate(outcomes: DataFrame, host="host", ts="ts", ok="ok",
                        seconds: int = fixed.MONITOR_SECONDS) -> DataFrame:
    """Share of failures among the calls of the last ``seconds`` at every row.

    Windows run per (host, time segment) over the segment and a copy of the one before, so a
    hot host is spread over all segments.
    """
    near = halo(outcomes, ts, seconds).withColumn("_t", F.unix_micros(F.col(ts)))
    w = W.partitionBy(host, SEG).orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    rated = near.withColumn("calls", F.count("*").over(w)).withColumn(
        "failures", F.count_if(~F.col(ok)).over(w)
    )
    return rated.filter("native").withColumn(
        "failure_rate", F.col("failures") / F.col("calls")
    ).drop(SEG, "native", "_t")


def rate_multiplier(outcomes: DataFrame, host="host", ts="ts", ok="ok", tie="id", tiers: tuple[int, ...] | None = None) -> DataFrame:
    """Adaptive rate multiplier per host after its last outcome.

    A failure multiplies by 0.7 (not below 0.1), a success adds 0.05 (not above 1). Both are
    clamped affine maps, and so is their composition: x -> clamp(a*x + b, lo, hi).
    """
    low, high, good = F.lit(fixed.MIN_MULTIPLIER), F.lit(fixed.MAX_MULTIPLIER), F.col(ok)
    one = F.struct(
        F.when(good, F.lit(1.0)).otherwise(F.lit(fixed.BACKOFF_FACTOR)).alias("a"), F.when(good, F.lit(fixed.RECOVERY_STEP)).otherwise(F.lit(0.0)).alias("b"),
        low.alias("lo"), high.alias("hi"))

    def after(f, g):
        clamp = lambda x: F.least(F.greatest(g["a"] * x + g["b"], g["lo"]), g["hi"])
        return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), clamp(f["lo"]).alias("lo"), clamp(f["hi"]).alias("hi"))

    composed = compose(outcomes, host, [ts, tie], one, after, **({"tiers": tiers} if tiers else {}))
    value = F.least(F.greatest(F.col("f.a") * high + F.col("f.b"), F.col("f.lo")), F.col("f.hi"))
    return composed.select(host, value.alias("multiplier"))


def effective_limits(multipliers: DataFrame, limits: DataFrame | None = None, host="host") -> DataFrame:
    """Requests per minute and burst under the multiplier, with optional per-host limits.

    ``limits(host, rpm, burst)`` overrides the defaults for the hosts it names.
    """
    m = multipliers
    if limits is not None:
        m = m.join(limits.select(host, F.col("rpm").alias("_rpm"), F.col("burst").alias("_burst")), host, "left")
    else:
        m = m.withColumn("_rpm", F.lit(None).cast("double")).withColumn("_burst", F.lit(None).cast("int"))
    rpm = F.coalesce("_rpm", F.lit(fixed.REQUESTS_PER_MINUTE))
    burst = F.coalesce("_burst", F.lit(fixed.BURST_SIZE))
    full = F.col("multiplier") >= 1.0
    return m.select(
        host, "multiplier",
        F.when(full, rpm).otherwise(F.greatest(rpm * F.col("multiplier"), F.lit(0.01))).alias("rpm"),
        # rounded first: 20 * 0.35 is 7 whatever the order of the additions was
        F.when(full, burst.cast("long")).otherwise(
            F.greatest(F.floor(F.round(burst * F.col("multiplier"), 9)), F.lit(1))).cast("long").alias("burst"),
    )


def outcome_history(outcomes: DataFrame, host="host", ts="ts", tie="id", n: int = fixed.HISTORY_LENGTH) -> DataFrame:
    return top_k(outcomes, [host], [F.col(ts).desc(), F.col(tie).desc()], n)


def health_states(outcomes: DataFrame, key="engine", ts="ts", ok="ok", latency="latency_ms", tie="id",
                  priors: dict[str, tuple[float, float]] | None = None, default_prior=(1.0, 0.0),
                  error: str | None = None, tiers: tuple[int, ...] | None = None) -> DataFrame:
    """Per key: moving averages, counts, trailing failures, last outcome.

    An average step is ``x -> 0.7*x + 0.3*v``, the pair (factor, offset). Counts and last rows are plain aggregates.
    """
    keep, gain, good = F.lit(fixed.EMA_KEEP), F.lit(fixed.EMA_GAIN), F.col(ok)
    one = F.struct(
        keep.alias("a"), F.when(good, gain).otherwise(F.lit(0.0)).alias("s"), (F.greatest(F.col(latency).cast("double"), F.lit(0.0)) * gain).alias("l"),
        F.when(good, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("trail"), good.alias("any_ok"))

    def after(f, g):
        return F.struct(
            (f["a"] * g["a"]).alias("a"), (f["s"] * g["a"] + g["s"]).alias("s"), (f["l"] * g["a"] + g["l"]).alias("l"),
            F.when(g["any_ok"], g["trail"]).otherwise(f["trail"] + g["trail"]).alias("trail"), (f["any_ok"] | g["any_ok"]).alias("any_ok"))

    composed = compose(outcomes, key, [ts, tie], one, after, **({"tiers": tiers} if tiers else {}))
    err = F.col(error) if error else F.lit(None).cast("string")
    counted = outcomes.groupBy(key).agg(
        F.count("*").alias("attempts"), F.count_if(good).alias("successes"),
        F.max_by(F.struct(F.col(ts).alias("ts"), F.when(~good, err).alias("err")), F.struct(F.col(ts), F.col(tie))).alias("last"),
        F.max(F.when(good, F.col(ts))).alias("last_success"), F.max(F.when(~good, F.col(ts))).alias("last_failure"))
    per_key = counted.join(composed, key)

    def chain(field, prior):
        return F.col("f.a") * prior + F.col(f"f.{field}")

    trail = F.col("f.trail")
    table = priors or {}
    p_success, p_latency = F.lit(float(default_prior[0])), F.lit(float(default_prior[1]))
    for name, (s, l) in table.items():
        p_success = F.when(F.col(key) == name, F.lit(float(s))).otherwise(p_success)
        p_latency = F.when(F.col(key) == name, F.lit(float(l))).otherwise(p_latency)
    return per_key.select(
        key, chain("s", p_success).alias("success_ema"), chain("l", p_latency).alias("latency_ema_ms"),
        "attempts", "successes", trail.alias("consecutive_failures"),
        F.col("last.ts").alias("last_ts"), F.col("last.err").alias("last_error_code"),
        "last_success", "last_failure",
    )


def engine_score(success_ema, latency_ema) -> Column:
    s = F.col(success_ema) if isinstance(success_ema, str) else success_ema
    l = F.col(latency_ema) if isinstance(latency_ema, str) else latency_ema
    return F.round(F.greatest(F.lit(0.0), s * 100.0 - F.least(l, F.lit(15000.0)) / 300.0), 2)


def cooldown_left(states: DataFrame, as_of: Column, threshold: int, seconds: float, name: str) -> DataFrame:
    """Seconds a key still rests: its trailing failures reached the threshold recently."""
    until = F.unix_micros("last_ts") + int(seconds * 1_000_000)
    left = F.greatest(F.lit(0.0), (until - F.unix_micros(as_of)) / 1_000_000.0)
    return states.withColumn(name, F.when(F.col("consecutive_failures") >= threshold, left).otherwise(0.0))


def engine_snapshot(states: DataFrame, as_of: Column, priors: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Status report of every engine of the priors, tried or not."""
    priors = priors or fixed.ENGINE_PRIORS
    spark = states.sparkSession
    known = spark.createDataFrame([(k, s, l) for k, (s, l) in priors.items()], "engine string, _s double, _l double")
    all_states = known.join(states, "engine", "left").withColumn(
        "success_ema", F.coalesce("success_ema", "_s")).withColumn("latency_ema_ms", F.coalesce("latency_ema_ms", "_l"))
    for c in ("attempts", "successes", "consecutive_failures"):
        all_states = all_states.withColumn(c, F.coalesce(c, F.lit(0)))
    rested = cooldown_left(all_states, as_of, fixed.ENGINE_FAILURES, fixed.ENGINE_COOLDOWN_SECONDS, "open_for")
    status = (
        F.when(F.col("open_for") > 0, "open").when(F.col("attempts") == 0, "untried")
        .when(F.col("consecutive_failures") > 0, "degraded").otherwise("healthy")
    )
    return rested.select(
        "engine", status.alias("status"), engine_score("success_ema", "latency_ema_ms").alias("score"),
        "attempts", "successes", "consecutive_failures", F.round("latency_ema_ms", 2).alias("latency_ema_ms"),
        F.round("open_for", 2).alias("circuit_open_for_seconds"), "last_error_code",
    )


def select_engines(snapshot: DataFrame, requested: str = "auto", fallback: bool = True) -> DataFrame:
    """Engines that may be asked, best score first."""
    s = snapshot.filter(F.col("status") != "open")
    if requested != "auto":
        s = s.filter(F.col("engine") == requested)
    prior_rank = F.array_position(F.array(*[F.lit(n) for n in fixed.ENGINE_PRIORS]), F.col("engine"))
    s = s.orderBy(F.col("score").desc(), prior_rank)
    return s.limit(1) if requested == "auto" and not fallback else s


# ---- circuit breaker ---------------------------------------------------------------------

# "flying" maps calls under way to the half-open window (epoch) they probe, if any
BREAKER_START = {"state": "closed", "since": None, "run": 0, "calls": 0, "epoch": 0, "flying": {}}


def _settled(s: dict) -> dict:
    """The same state without history: the current window is 0, every earlier one -1."""
    now = s["epoch"]
    flying = {c: p if p is None else (0 if p == now else -1) for c, p in s["flying"].items()}
    closed = s["state"] == "closed"
    return {**s, "epoch": 0, "flying": flying, "since": None if closed else s["since"], "calls": 0 if closed else s["calls"]}


def breaker_step(threshold=fixed.FAILURE_THRESHOLD, recovery=fixed.RECOVERY_SECONDS, probes=fixed.HALF_OPEN_CALLS):
    """Transition function of the breaker over start (0) and end (1) events of calls."""
    wait = int(recovery * 1_000_000)

    def move_on_time(s, now):
        due = s["since"] is not None and now - s["since"] >= wait
        if due and s["state"] == "open" or due and s["state"] == "half_open" and s["calls"] >= probes:
            s.update(state="half_open", since=now, calls=0, epoch=s["epoch"] + 1)

    def step(state, rows):
        s = {**state, "flying": dict(state["flying"])}
        out = []
        for r in rows:
            now, call = int(r["event_us"]), str(r["call_id"])
            admitted = True
            if r["kind"] == 0:
                probe = None
                move_on_time(s, now)
                if s["state"] == "half_open":
                    admitted = s["calls"] < probes
                    if admitted:
                        s["calls"] += 1
                        probe = s["epoch"]
                else:
                    admitted = s["state"] == "closed"
                if admitted:
                    s["flying"][call] = probe
            else:
                if call not in s["flying"]:
                    continue
                probe = s["flying"].pop(call)
                own = s["state"] == "half_open" and probe is not None and probe == s["epoch"]
                if r["ok"]:
                    s["run"] = 0
                    if own:
                        s.update(state="closed", since=now)
                else:
                    s["run"] += 1
                    if own or s["state"] == "closed" and s["run"] >= threshold:
                        s.update(state="open", since=now)
            out.append((r["host"], r["call_id"], now, "start" if r["kind"] == 0 else "end", admitted,
                        s["state"], s["since"], s["run"]))
        return _settled(s), out

    return step


def replay_breaker(outcomes: DataFrame, threshold=fixed.FAILURE_THRESHOLD, recovery=fixed.RECOVERY_SECONDS,
                   probes=fixed.HALF_OPEN_CALLS, width: int = HOUR, target_rows: int = 500_000) -> DataFrame:
    """Breaker state after every call start and end of ``(host, call_id, start_ts, ts, ok)``.

    A call that was not admitted has no end event. Late results of calls that started before
    a half-open window never decide it.
    """
    moments = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("start_ts").alias("event_ts")),
        F.struct(F.lit(1).alias("kind"), F.col("ts").alias("event_ts")),
    )
    events = outcomes.select("host", "call_id", "ok", F.explode(moments).alias("m")).select(
        "host", "call_id", "ok", "m.kind", "m.event_ts", F.unix_micros("m.event_ts").alias("event_us"))
    key_type = outcomes.schema["host"].dataType.simpleString()
    id_type = outcomes.schema["call_id"].dataType.simpleString()
    out = fold(
        events, "host", "event_ts", breaker_step(threshold, recovery, probes), BREAKER_START,
        f"host {key_type}, call_id {id_type}, event_us long, kind string, admitted boolean, state string, since_us long, run long",
        {"host": None, "call_id": None, "event_us": "int64", "kind": None, "admitted": "bool", "state": None,
         "since_us": "Int64", "run": "int64"},
        width, ties=["kind", "call_id"], target_rows=target_rows,
    )
    return out.withColumn("event_ts", F.timestamp_micros("event_us")).withColumn("since", F.timestamp_micros("since_us")).drop("event_us", "since_us")


def breaker_stats(replayed: DataFrame, outcomes: DataFrame, as_of: Column, recovery=fixed.RECOVERY_SECONDS) -> DataFrame:
    """Last state per host at ``as_of`` plus totals of the admitted calls."""
    rank = F.struct("event_ts", F.when(F.col("kind") == "end", 1).otherwise(0), "call_id")
    last = replayed.groupBy("host").agg(F.max_by(F.struct("state", "since", "run"), rank).alias("_l"))
    ends = replayed.filter("kind = 'end'").join(outcomes.select("host", "call_id", "ok"), ["host", "call_id"])
    totals = ends.groupBy("host").agg(
        F.count_if(~F.col("ok")).alias("total_failures"), F.count_if(F.col("ok")).alias("total_successes"),
        F.max(F.when(~F.col("ok"), F.col("event_ts"))).alias("last_failure_time"),
        F.max(F.when(F.col("ok"), F.col("event_ts"))).alias("last_success_time"),
    )
    open_for = (F.unix_micros(as_of) - F.unix_micros("_l.since")) / 1_000_000.0
    was_open = F.col("_l.state") == "open"
    return totals.join(last, "host").select(
        "host",
        F.when(was_open & (open_for >= recovery), "half_open").otherwise(F.col("_l.state")).alias("state"),
        F.col("_l.run").alias("consecutive_failures"), "total_failures", "total_successes",
        "last_failure_time", "last_success_time",
        F.when(was_open & (open_for < recovery), F.round(recovery - open_for, 1)).otherwise(0.0).alias("retry_after_seconds"),
    )


def open_circuits(stats: DataFrame) -> DataFrame:
    return stats.filter("state <> 'closed'").select("host", "state", "retry_after_seconds").orderBy("host")


# ---- token bucket ------------------------------------------------------------------------

BUCKET_START = {"tokens": None, "last": None, "recent": []}


def bucket_step(state, rows):
    """Refill, spend one token, or fall back to the sliding window (tokens may go negative)."""
    tokens, last, recent = state["tokens"], state["last"], list(state["recent"])
    out = []
    for r in rows:
        now, rpm, burst, window = int(r["req_us"]) / 1e6, float(r["rpm"]), float(r["burst"]), float(r["window_s"])
        if tokens is None:
            tokens, last = burst, now
        tokens = min(tokens + (now - last) * rpm / 60.0, burst)
        last = now
        recent = [t for t in recent if t >= now - window]
        admitted = tokens >= 1.0 or (window > 0 and len(recent) < rpm)
        if admitted:
            tokens -= 1.0
            recent.append(now)
        out.append((r["host"], r["req_id"], int(r["req_us"]), bool(admitted), tokens, len(recent)))
    return {"tokens": tokens, "last": last, "recent": recent}, out


def replay_bucket(requests: DataFrame, limits: DataFrame | None = None, width: int = HOUR, target_rows: int = 500_000) -> DataFrame:
    """Admission of every request ``(host, req_id, ts)``; ``limits(host, rpm, burst)`` per host."""
    r = requests.select("host", "req_id", "ts", F.unix_micros("ts").alias("req_us"))
    if limits is not None:
        r = r.join(limits.select("host", F.col("rpm").alias("_r"), F.col("burst").alias("_b")), "host", "left")
    else:
        r = r.withColumn("_r", F.lit(None).cast("double")).withColumn("_b", F.lit(None).cast("double"))
    r = r.select(
        "host", "req_id", "ts", "req_us", F.coalesce("_r", F.lit(fixed.REQUESTS_PER_MINUTE)).alias("rpm"),
        F.coalesce(F.col("_b").cast("double"), F.lit(float(fixed.BURST_SIZE))).alias("burst"),
        F.lit(fixed.WINDOW_SECONDS).alias("window_s"),
    )
    key_type = requests.schema["host"].dataType.simpleString()
    id_type = requests.schema["req_id"].dataType.simpleString()
    out = fold(
        r, "host", "ts", bucket_step, BUCKET_START,
        f"host {key_type}, req_id {id_type}, req_us long, admitted boolean, tokens double, in_window int",
        {"host": None, "req_id": None, "req_us": "int64", "admitted": "bool", "tokens": "float64", "in_window": "int32"},
        width, ties=["req_id"], target_rows=target_rows,
    )
    return out.withColumn("ts", F.timestamp_micros("req_us")).drop("req_us")


def limiter_stats(replayed: DataFrame, as_of: Column, window: float = fixed.WINDOW_SECONDS) -> DataFrame:
    """Totals per host and admitted requests of the last window."""
    cutoff = F.unix_micros(as_of) - int(window * 1_000_000)
    recent = F.col("admitted") & (F.unix_micros("ts") >= cutoff)
    return replayed.groupBy("host").agg(
        F.count_if("admitted").alias("total_requests"),
        F.count_if(~F.col("admitted")).alias("blocked_count"),
        F.count_if(recent).alias("requests_in_window"),
    )


# ---- endpoints ---------------------------------------------------------------------------

def endpoint_identity(server, username) -> Column:
    """Stable identity of an account on a server; passwords are not part of it."""
    s = F.col(server) if isinstance(server, str) else server
    u = F.col(username) if isinstance(username, str) else username
    return F.sha2(F.concat_ws("\0", F.lit(fixed.ENDPOINT_IDENTITY_VERSION), s, F.coalesce(u, F.lit(""))), 256)


def public_identity(server, username) -> Column:
    return F.concat(F.lit("proxy-"), F.substring(endpoint_identity(server, username), 1, 16))


def rendezvous(keys: DataFrame, key: str, endpoints: DataFrame, identity: str = "identity", block: int = 1000) -> DataFrame:
    """Endpoint with the highest hash of (key, identity).

    Endpoints lie in a table of blocks; a key meets every block once, by its number, and takes its best there.
    """
    ids = endpoints.select(identity).distinct()
    blocks = ranked(ids, [identity]).groupBy(F.floor(F.col("_place") / block).alias("_block")).agg(F.collect_list(identity).alias("_ids"))
    n = blocks.count()
    k = F.col(key).cast("string")
    met = keys.select(key).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))).cast("array<bigint>"))).join(blocks, "_block")
    scored = F.array_max(F.transform("_ids", lambda e: F.struct(F.sha2(F.concat(k, F.lit("\0"), e), 256).alias("h"), e.alias("e"))))
    best = met.groupBy(key).agg(F.max(scored).getField("e").alias("endpoint"))
    return keys.join(best.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def round_robin(requests: DataFrame, order: str, endpoints: DataFrame, identity: str = "identity", ties: list[str] | None = None) -> DataFrame:
    """Endpoints in turn over the requests in order; places come from the sizes of ranges."""
    ids = ranked(endpoints.select(identity).distinct(), [identity]).select(F.col("_place").alias("_slot"), F.col(identity).alias("endpoint"))
    n = ids.count()
    turns = ranked(requests, [order, *(ties or [])]).withColumn("_slot", F.col("_place") % F.lit(max(1, n)))
    return turns.join(ids, "_slot").drop("_slot", "_place")
