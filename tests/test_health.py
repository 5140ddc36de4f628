import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webcorpus.functions import failures as E, fixed
from webcorpus.operators import health as Hh

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def breaker(spark, calls, **kw):
    rows = [("h", i, at(a), at(b), ok) for i, (a, b, ok) in enumerate(calls)]
    df = spark.createDataFrame(rows, "host string, call_id long, start_ts timestamp, ts timestamp, ok boolean")
    out = Hh.replay_breaker(df, threshold=2, recovery=10.0, **kw).collect()
    return {(r.call_id, r.kind): (r.admitted, r.state) for r in out}


def test_opens_after_threshold_and_rejects(spark):
    r = breaker(spark, [(0, 1, False), (2, 3, False), (5, 6, True)])
    assert r[(0, "end")] == (True, "closed") and r[(1, "end")] == (True, "open") and r[(2, "start")] == (False, "open") and (2, "end") not in r


def test_recovers_through_one_probe(spark):
    r = breaker(spark, [(0, 1, False), (2, 3, False), (13, 16, True), (14, 15, True), (17, 18, True)])
    assert r[(2, "start")] == (True, "half_open") and r[(3, "start")] == (False, "half_open") and r[(2, "end")] == (True, "closed") and r[(4, "end")] == (True, "closed")


def test_failed_probe_reopens(spark):
    r = breaker(spark, [(0, 1, False), (2, 3, False), (13, 14, False), (15, 16, True), (24, 25, True)])
    assert r[(2, "end")] == (True, "open") and r[(3, "start")] == (False, "open") and r[(4, "start")] == (True, "half_open") and r[(4, "end")][1] == "closed"


def test_late_failure_does_not_extend_the_open_time(spark):
    r = breaker(spark, [(0, 9, False), (0.5, 1, False), (2, 3, False), (13.5, 14, True)])
    assert r[(0, "end")] == (True, "open") and r[(3, "start")] == (True, "half_open")


def test_straggler_does_not_decide_half_open(spark):
    r = breaker(spark, [(0, 15, False), (0.5, 1, False), (2, 3, False), (14, 20, True)])
    assert r[(0, "end")] == (True, "half_open") and r[(3, "end")] == (True, "closed")
    r = breaker(spark, [(0, 15, True), (0.5, 1, False), (2, 3, False), (14, 20, False)])
    assert r[(0, "end")] == (True, "half_open") and r[(3, "end")] == (True, "open")


def test_abandoned_probe_frees_its_slot_and_reports_in_vain(spark):
    r = breaker(spark, [(0, 1, False), (2, 3, False), (13, 30, False), (15, 16, True), (24, 40, True)])
    assert r[(3, "start")] == (False, "half_open") and r[(4, "start")] == (True, "half_open")
    assert r[(2, "end")] == (True, "half_open") and r[(4, "end")] == (True, "closed")


def sequential(rows, step, start):
    return step(start, rows)[1]


@pytest.mark.parametrize("target", [3, 20, 1000])
def test_segments_give_the_sequential_breaker(spark, target):
    rnd = random.Random(7)
    t, rows = 0.0, []
    for i in range(400):
        t += rnd.choice([0.2, 0.5, 1, 4, 15])
        rows.append(("hot" if rnd.random() < 0.5 else f"h{i % 5}", i, at(t), at(t + rnd.choice([0, 0.1, 2, 12])), rnd.random() > 0.55))
    df = spark.createDataFrame(rows, "host string, call_id long, start_ts timestamp, ts timestamp, ok boolean")
    out = Hh.replay_breaker(df, threshold=2, recovery=10.0, width=600, target_rows=target)
    got = {(r.host, r.call_id, r.kind): (r.admitted, r.state, r.run) for r in out.collect()}
    want = {}
    us = lambda d: int((d - datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5)
    for host in {r[0] for r in rows}:
        ev = sorted([(us(s), 0, i, ok) for h, i, s, e, ok in rows if h == host] + [(us(e), 1, i, ok) for h, i, s, e, ok in rows if h == host])
        ev = [{"host": host, "event_us": t, "kind": k, "call_id": i, "ok": ok} for t, k, i, ok in ev]
        for h, i, _, kind, adm, state, _, run in sequential(ev, Hh.breaker_step(2, 10.0), Hh.BREAKER_START):
            want[(h, i, kind)] = (adm, state, run)
    assert got == want


@pytest.mark.parametrize("target", [4, 1000])
def test_segments_give_the_sequential_bucket(spark, target):
    rnd = random.Random(5)
    t, rows = 0.0, []
    for i in range(300):
        t += rnd.choice([0.05, 0.2, 1, 30])
        rows.append(("hot" if i % 3 else "b", i, at(t)))
    df = spark.createDataFrame(rows, "host string, req_id long, ts timestamp")
    limits = spark.createDataFrame([("hot", 6.0, 2)], "host string, rpm double, burst int")
    got = {r.req_id: (r.admitted, round(r.tokens, 6)) for r in Hh.replay_bucket(df, limits, width=300, target_rows=target).collect()}
    want = {}
    for host, rpm, burst in (("hot", 6.0, 2.0), ("b", 60.0, 20.0)):
        rs = [{"host": host, "req_id": i, "req_us": int((s - datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5), "rpm": rpm, "burst": burst, "window_s": 60.0} for h, i, s in rows if h == host]
        want |= {o[1]: (o[3], round(o[4], 6)) for o in sequential(rs, Hh.bucket_step, Hh.BUCKET_START)}
    assert got == want


def test_bucket_burst_then_window_then_block(spark):
    rows = [("h", i, at(i * 0.001)) for i in range(8)] + [("h", 9, at(61))]
    limits = spark.createDataFrame([("h", 5.0, 2)], "host string, rpm double, burst int")
    r = {x.req_id: x.admitted for x in Hh.replay_bucket(spark.createDataFrame(rows, "host string, req_id long, ts timestamp"), limits).collect()}
    assert [r[i] for i in range(8)] == [True] * 5 + [False] * 3 and r[9]


def test_adaptive_multiplier(spark):
    seqs = {"one": "F", "three": "FFF", "recover": "F" * 5 + "S" * 20, "floor": "F" * 20, "mixed": "FSFFSSFSFFFS"}
    rows = [(h, i, at(i), c == "S") for h, s in seqs.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "host string, id long, ts timestamp, ok boolean")
    m = 1.0
    for c in seqs["mixed"]:
        m = min(m + 0.05, 1.0) if c == "S" else max(m * 0.7, 0.1)
    want = {"one": 0.7, "three": 0.343, "recover": 1.0, "floor": 0.1, "mixed": m}
    for tiers in ((0, 1, 33), (1, 2, 3, 33), None):
        got = {r.host: r.multiplier for r in Hh.rate_multiplier(df.repartition(3), tiers=tiers).collect()}
        assert all(abs(got[h] - w) < 1e-9 for h, w in want.items())
    lim = {r.host: (round(r.rpm, 6), r.burst) for r in Hh.effective_limits(Hh.rate_multiplier(df)).collect()}
    assert lim["one"] == (42.0, 14) and lim["floor"] == (6.0, 2) and lim["recover"] == (60.0, 20)


def test_engines(spark):
    rows = [("bing", 1, at(0), False, 100.0, "timeout"), ("bing", 2, at(1), False, 100.0, "captcha"), ("brave", 3, at(2), True, 500.0, None)]
    df = spark.createDataFrame(rows, "engine string, id long, ts timestamp, ok boolean, latency_ms double, code string")
    for tiers in ((0, 1, 33), None):
        st = Hh.health_states(df, priors=fixed.ENGINE_PRIORS, error="code", tiers=tiers)
        snap = {r.engine: r for r in Hh.engine_snapshot(st, F.lit(at(11)).cast("timestamp")).collect()}
        assert {e: r.status for e, r in snap.items()} == {"bing": "open", "brave": "healthy", "duckduckgo": "untried"}
        assert snap["bing"].circuit_open_for_seconds == 20.0 and snap["bing"].last_error_code == "captcha" and snap["bing"].consecutive_failures == 2
        assert snap["duckduckgo"].score == 81.67 and snap["brave"].latency_ema_ms == 1480.0
        order = [r.engine for r in Hh.select_engines(Hh.engine_snapshot(st, F.lit(at(11)).cast("timestamp"))).collect()]
        assert order == ["brave", "duckduckgo"]


def test_folds_of_a_hot_host_match_plain_loops(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"h{rng.randrange(5)}", i, at(i // 3), rng.random() < 0.6, rng.random() * 3000 - 100) for i in range(6000)]
    df = spark.createDataFrame(rows, "host string, id long, ts timestamp, ok boolean, latency_ms double").repartition(7)
    m, s, l, run, runs = {}, {}, {}, {}, {}
    for h, i, _, good, lat in rows:
        m[h] = min(m.get(h, 1.0) + 0.05, 1.0) if good else max(m.get(h, 1.0) * 0.7, 0.1)
        s[h], l[h] = s.get(h, 1.0) * 0.7 + good * 0.3, l.get(h, 0.0) * 0.7 + max(lat, 0) * 0.3
        run[h] = runs[i] = 0 if good else run.get(h, 0) + 1
    got = {r.host: r.multiplier for r in Hh.rate_multiplier(df, tiers=(2, 5, 33)).collect()}
    assert got.keys() == m.keys() and all(abs(got[h] - m[h]) < 1e-12 for h in m)
    for r in Hh.health_states(df, key="host", tiers=(3, 33)).collect():
        assert abs(r.success_ema - s[r.host]) < 1e-12 and abs(r.latency_ema_ms - l[r.host]) < 1e-9 and r.consecutive_failures == run[r.host]
    assert {r.id: r.run_length for r in Hh.consecutive_failures(df, ties=["id"]).collect()} == runs


def test_endpoints(spark):
    ep = spark.createDataFrame([(f"http://p{i}:80", None if i % 2 else "u") for i in range(4)], "server string, username string").withColumn("identity", Hh.endpoint_identity("server", "username"))
    ids = [r.identity for r in ep.collect()]
    import hashlib
    assert ids[1] == hashlib.sha256(b"proxy-endpoint-v1\0http://p1:80\0").hexdigest() and len(set(ids)) == 4
    keys = spark.range(50).select(F.col("id").cast("string").alias("k"))
    got = {r.k: r.endpoint for r in Hh.rendezvous(keys, "k", ep).collect()}
    assert got == {str(k): max(ids, key=lambda e: hashlib.sha256(f"{k}\0{e}".encode()).digest()) for k in range(50)}
    assert {r.k: r.endpoint for r in Hh.rendezvous(keys, "k", ep, block=3).collect()} == got
    reqs = spark.range(50).select("id", F.timestamp_seconds(F.col("id") * 100).alias("ts"))
    rr = Hh.round_robin(reqs, "ts", ep, ties=["id"]).orderBy("id").collect()
    assert [r.endpoint for r in rr] == [sorted(ids)[i % 4] for i in range(50)]


def test_failure_classes(col):
    msgs = [("Please solve the CAPTCHA", "x"), ("Login required", "x"), ("late", "TimeoutError"), ("no", "ConnectionResetError"), ("HTTP 429", "x"), ("502", "x"), ("gateway timeout", "x"), ("?", "x")]
    got = col(lambda m, t: E.error_class(F.col(m), F.col(t)), msgs, "m", "t")
    assert [tuple(g) for g in got] == [("captcha", 403), ("paywall", 402), ("timeout", 408), ("connection", 502), ("rate_limited", 429), ("server_error", 502), ("server_error", 504), ("unknown", 500)]
    assert col(E.exception_code, ["XTimeoutErrorY", "ValueError", "Boom"]) == ["timeout", "invalid_url", "navigation_failed"]
    st = col(lambda s: E.failure(F.col(s), F.lit(None).cast("string")), [None, "200", "404", "abc"])
    assert [s and tuple(s) for s in st] == [None, None, (404, "Upstream returned HTTP 404"), (500, "Upstream returned HTTP 500")]
    assert col(E.counts_against_host, [None, "403", "404", "429", "500", "x"]) == [False, False, False, True, True, True]


@pytest.mark.parametrize("headers, url, want", [
    ({}, "http://a/", "light"), ({"Server": "Vercel"}, "http://a/", "full"), ({"X-Next-Foo": "1"}, "http://a/", "full"), ({"CF-RAY": "1"}, "http://a/", "full"), ({"Content-Length": "1999"}, "http://a/", "full"),
    ({"content-length": "n/a", "content-type": "Text/HTML"}, "http://a/", "light"), ({"content-type": "application/json"}, "http://a/", "full"), ({}, "http://a/#/x", "full"),
])
def test_render_mode(spark, headers, url, want):
    df = spark.createDataFrame([(url, headers)], "url string, h map<string,string>")
    assert df.select(E.render_mode("url", "h")).first()[0] == want
