"""Queries: failure classes, host health, limits, engines and endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import failures as E, fixed
from ..operators import health as Hh
from ..operators.segments import running
from . import fixtures as fx, sqltext as q
from .registry import query

# one status, message and exception name per event, cycling through the cases
_STATUS = "[200, 404, 429, 500, 502, 503, 504, 403, 401, 400, 413, 408, 407, 302][1 + event_id % 14]"
_MESSAGES = [
    "Please verify you are human", "Subscription required to read", "HTTP 429 Too Many Requests", "503 Service Unavailable", "bad gateway",
    "504 from upstream", "Connection reset by peer", "request timed out", "navigate failed: net::ERR", "CapacityExceeded", "something else", "ERR_TUNNEL broken",
]
_NAMES = ["TimeoutError", "ConnectionError", "OSError", "ValueError", "CircuitOpenError", "UnsupportedRenderModeError", "EmptyPageError", "KeyError"]
_MSG = "['" + "', '".join(_MESSAGES) + "'][1 + event_id % 12] || ' ' || user_id"
_EXC = "['" + "', '".join(_NAMES) + "'][1 + event_id % 8]"


def _cases(t):
    e = F.col("event_id")

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (e % len(values) + 1).cast("int"))

    return t("events").select(
        e.alias("event_id"), pick([200, 404, 429, 500, 502, 503, 504, 403, 401, 400, 413, 408, 407, 302]).alias("status"),
        F.concat_ws(" ", pick(_MESSAGES), F.col("user_id").cast("string")).alias("message"), pick(_NAMES).alias("name"))


def _like(m, words):
    return "regexp_matches(" + m + ", '" + "|".join(words) + "')"


@query("h1_fetch_failure", sql=f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 500 WHEN event_id % 10 = 0 THEN 500 WHEN {_STATUS} >= 400 THEN {_STATUS} END::BIGINT AS status,
  CASE WHEN event_id % 9 = 0 THEN 'Scraper returned no data' WHEN event_id % 3 = 0 AND (event_id % 10 = 0 OR {_STATUS} >= 400) THEN {_MSG} WHEN event_id % 10 = 0 THEN 'Upstream returned HTTP 500' WHEN {_STATUS} >= 400 THEN 'Upstream returned HTTP ' || {_STATUS} END AS message FROM events""")
def _(t):
    raw = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("status").cast("string"))
    f = E.failure(raw, F.when(F.col("event_id") % 3 == 0, F.col("message")), F.col("event_id") % 9 != 0)
    return _cases(t).select("event_id", f["status"].alias("status"), f["message"].alias("message"))


@query("h2_counts_against_host", sql=f"SELECT event_id, event_id % 6 <> 0 AND ({_STATUS} = 429 OR {_STATUS} >= 500) AS counts FROM events")
def _(t):
    return _cases(t).select("event_id", E.counts_against_host("status", F.col("event_id") % 6 == 0).alias("counts"))


@query("h3_error_class", sql=f"""SELECT event_id, CASE WHEN {_like('m', fixed.CAPTCHA_WORDS)} THEN 'captcha' WHEN {_like('m', fixed.PAYWALL_WORDS)} THEN 'paywall' WHEN n = 'timeouterror' THEN 'timeout' WHEN n IN ('connectionerror', 'oserror') THEN 'connection'
    WHEN {_like('m', ['429', 'too many requests'])} THEN 'rate_limited' WHEN {_like('m', ['503', 'service unavailable', '502', 'bad gateway', '504', 'gateway timeout'])} THEN 'server_error' ELSE 'unknown' END AS error_type,
  CASE WHEN {_like('m', fixed.CAPTCHA_WORDS)} THEN 403 WHEN {_like('m', fixed.PAYWALL_WORDS)} THEN 402 WHEN n = 'timeouterror' THEN 408 WHEN n IN ('connectionerror', 'oserror') THEN 502
    WHEN {_like('m', ['429', 'too many requests'])} THEN 429 WHEN {_like('m', ['503', 'service unavailable'])} THEN 503 WHEN {_like('m', ['502', 'bad gateway'])} THEN 502 WHEN {_like('m', ['504', 'gateway timeout'])} THEN 504 ELSE 500 END::BIGINT AS status
  FROM (SELECT event_id, lower({_MSG}) AS m, lower({_EXC}) AS n FROM events)""")
def _(t):
    return _cases(t).select("event_id", E.error_class("message", "name").alias("k")).select("event_id", "k.error_type", "k.status")


@query("h4_status_code", sql=f"SELECT event_id, CASE {_STATUS} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.STATUS_CODES.items()) + " ELSE 'internal_error' END AS code FROM events")
def _(t):
    return _cases(t).select("event_id", E.status_code_name("status").alias("code"))


@query("h5_exception_code", sql=f"""SELECT event_id, CASE {_EXC} WHEN 'TimeoutError' THEN 'timeout' WHEN 'ValueError' THEN 'invalid_url' WHEN 'CircuitOpenError' THEN 'circuit_open' WHEN 'UnsupportedRenderModeError' THEN 'unsupported_option'
  WHEN 'EmptyPageError' THEN 'empty_content' ELSE 'navigation_failed' END AS code FROM events""")
def _(t):
    return _cases(t).select("event_id", E.exception_code("name").alias("code"))


@query("h6_proxy_failure", sql=f"SELECT event_id, {_STATUS} IN (407, 429, 502, 503, 504) OR {_like(f'lower({_MSG})', fixed.PROXY_MARKERS)} AS likely FROM events")
def _(t):
    return _cases(t).select("event_id", E.proxy_failure_likely("status", "message").alias("likely"))


@query("h7_engine_error", sql=f"""SELECT event_id, CASE WHEN n = 'timeouterror' OR contains(m, 'timeout') THEN 'timeout' WHEN n IN ('connectionerror', 'oserror') OR contains(m, 'connection') THEN 'connection_error' WHEN contains(m, 'capacity') THEN 'service_unavailable'
  WHEN contains(m, 'captcha') OR contains(m, 'challenge') THEN 'captcha_detected' WHEN contains(m, 'navigate') THEN 'navigation_failed' ELSE 'upstream_error' END AS code FROM (SELECT event_id, lower({_MSG}) AS m, lower({_EXC}) AS n FROM events)""")
def _(t):
    return _cases(t).select("event_id", E.engine_error("message", "name").alias("code"))


@query("h8_render_mode", sql="""SELECT event_id, CASE WHEN event_id % 6 = 0 OR event_id % 6 = 1 OR event_id % 6 = 2 OR (event_id % 6 = 3 AND user_id * 100 < 2000) OR event_id % 6 = 4 OR user_id % 7 = 0 THEN 'full' ELSE 'light' END AS mode FROM events""")
def _(t):
    m = F.col("event_id") % 6
    h = lambda k, v: F.create_map(F.lit(k), v if not isinstance(v, str) else F.lit(v))
    headers = (F.when(m == 0, h("Server", "Cloudflare-nginx")).when(m == 1, h("X-Nuxt-Id", "1")).when(m == 2, h("CF-Ray", "x"))
               .when(m == 3, h("Content-Length", (F.col("user_id") * 100).cast("string"))).when(m == 4, h("content-type", "application/pdf")).otherwise(h("Content-Type", "text/html; charset=utf-8")))
    url = F.when(F.col("user_id") % 7 == 0, "http://x/#/home").otherwise("http://x/")
    return t("events").select("event_id", E.render_mode(url, headers).alias("mode"))


@query("h9_retry_policy", sql="""SELECT event_id, NOT list_contains(['captcha', 'paywall', 'client_error'], k) AS retry, CASE WHEN k NOT IN ('captcha', 'paywall', 'client_error') THEN [1, 2, 4, 8, 16, 32][1 + least(event_id % 8 + CASE WHEN k = 'rate_limited' THEN 1 ELSE 0 END, 5)] END::BIGINT AS wait
  FROM (SELECT event_id, ['captcha', 'paywall', 'client_error', 'rate_limited', 'timeout', 'unknown'][1 + event_id % 6] AS k FROM events)""")
def _(t):
    k = F.element_at(F.array(*[F.lit(x) for x in ["captcha", "paywall", "client_error", "rate_limited", "timeout", "unknown"]]), (F.col("event_id") % 6 + 1).cast("int"))
    return t("events").select("event_id", k.alias("k"), (F.col("event_id") % 8).alias("a")).select("event_id", E.retryable("k").alias("retry"), E.backoff_seconds("k", "a").alias("wait"))


# ---- folds -------------------------------------------------------------------------------

_AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"


def _as_of():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def _breaker(t):
    """A breaker that opens on two failures in a row and rests for two hours."""
    return Hh.replay_breaker(fx.calls(t), threshold=2, recovery=7200.0)


_WALK = f"""WITH RECURSIVE {q.OUTCOMES}, o AS (SELECT host, id, epoch_us(ts) AS t, ok, row_number() OVER (PARTITION BY host ORDER BY ts, id) AS rn FROM outcomes),
  w AS (SELECT host, rn - 1 AS rn, id, t, ok, 'closed' AS st1, 0::BIGINT AS run1, true AS admitted, 'closed' AS st2, NULL::BIGINT AS since2, 0::BIGINT AS run2 FROM o WHERE rn = 1
    UNION ALL SELECT host, rn, id, t, ok, st1, run1, admitted, CASE WHEN NOT admitted THEN st1 WHEN ok THEN 'closed' WHEN st1 = 'half_open' OR run1 + 1 >= 2 THEN 'open' ELSE st1 END AS st2,
      CASE WHEN NOT admitted THEN since1 WHEN ok THEN NULL WHEN st1 = 'half_open' OR run1 + 1 >= 2 THEN t ELSE since1 END AS since2, CASE WHEN NOT admitted THEN run1 WHEN ok THEN 0 ELSE run1 + 1 END AS run2
    FROM (SELECT o.host, o.rn, o.id, o.t, o.ok, CASE WHEN w.st2 = 'open' AND o.t - w.since2 >= 7200000000 THEN 'half_open' ELSE w.st2 END AS st1, CASE WHEN w.st2 = 'open' AND o.t - w.since2 >= 7200000000 THEN o.t ELSE w.since2 END AS since1,
      w.run2 AS run1, w.st2 <> 'open' OR o.t - w.since2 >= 7200000000 AS admitted FROM w JOIN o ON o.host = w.host AND o.rn = w.rn + 1)),
  r AS (SELECT * FROM w WHERE rn > 0)"""


@query("h10_breaker_replay", sql=_WALK + """ SELECT host, id AS call_id, t AS event_ts, 'start' AS kind, admitted, st1 AS state, run1 AS run FROM r
  UNION ALL SELECT host, id, t, 'end', true, st2, run2 FROM r WHERE admitted""")
def _(t):
    return _breaker(t).select("host", "call_id", "event_ts", "kind", "admitted", "state", "run")


_STATS = _WALK + f""", l AS (SELECT host, max_by(st2, rn) AS st, max_by(since2, rn) AS since, max_by(run2, rn) AS run, count(*) FILTER (admitted AND NOT ok) AS total_failures, count(*) FILTER (admitted AND ok) AS total_successes,
    max(t) FILTER (admitted AND NOT ok) AS last_failure_time, max(t) FILTER (admitted AND ok) AS last_success_time FROM r GROUP BY 1),
  z AS (SELECT *, (epoch_us({_AS_OF}) - since) / 1000000.0::DOUBLE AS age FROM l),
  stats AS (SELECT host, CASE WHEN st = 'open' AND age >= 7200 THEN 'half_open' ELSE st END AS state, run AS consecutive_failures, total_failures, total_successes, last_failure_time, last_success_time,
    CASE WHEN st = 'open' AND age < 7200 THEN round(7200.0::DOUBLE - age, 1) ELSE 0.0::DOUBLE END AS retry_after_seconds FROM z)"""


@query("h11_breaker_stats", sql=_STATS + " SELECT * FROM stats")
def _(t):
    return Hh.breaker_stats(_breaker(t), fx.calls(t), _as_of(), recovery=7200.0)


@query("h12_open_circuits", sql=_STATS + " SELECT host, state, retry_after_seconds FROM stats WHERE state <> 'closed'")
def _(t):
    return Hh.open_circuits(Hh.breaker_stats(_breaker(t), fx.calls(t), _as_of(), recovery=7200.0))


@query("h13_failure_runs", sql=f"""WITH {q.OUTCOMES}, i AS (SELECT host, id, ok, ts, sum(ok::INT) OVER (PARTITION BY host ORDER BY ts, id) AS island FROM outcomes)
  SELECT host, id, CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY host, island ORDER BY ts, id) END::BIGINT AS run_length FROM i""")
def _(t):
    return Hh.consecutive_failures(fx.outcomes(t), ties=["id"]).select("host", "id", "run_length")


@query("h14_failure_rate", sql=f"""WITH {q.OUTCOMES}, w AS (SELECT host, id, count(*) OVER r AS calls, count(*) FILTER (NOT ok) OVER r AS failures FROM outcomes
  WINDOW r AS (PARTITION BY host ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW)) SELECT host, id, calls, failures, round(failures / calls, 6) AS failure_rate FROM w""")
def _(t):
    # the stored events are sparse: a ten-hour look-back instead of 120 seconds
    r = Hh.recent_failure_rate(fx.outcomes(t), seconds=36000)
    return r.select("host", "id", "calls", "failures", F.round("failure_rate", 6).alias("failure_rate"))


_MULT = f"""WITH {q.OUTCOMES}, o AS (SELECT host, list(ok ORDER BY ts, id) AS oks FROM outcomes GROUP BY 1),
  m AS (SELECT host, list_reduce(list_transform(oks, lambda x: x::INT::DOUBLE), lambda a, x: CASE WHEN x = 1 THEN least(a + 0.05::DOUBLE, 1.0::DOUBLE) ELSE greatest(a * 0.7::DOUBLE, 0.1::DOUBLE) END, 1.0::DOUBLE) AS m FROM o)"""


@query("h15_rate_multiplier", sql=_MULT + " SELECT host, round(m, 9) AS multiplier FROM m")
def _(t):
    return Hh.rate_multiplier(fx.outcomes(t)).select("host", F.round("multiplier", 9).alias("multiplier"))


_LIMITS = "l AS (SELECT 'h' || user_id AS host, (30 + user_id % 50)::DOUBLE AS rpm, 5 + user_id % 20 AS burst FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0))"


def _limits(t):
    u = t("events").filter("user_id % 2 = 0").select("user_id").distinct()
    return u.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), (30 + F.col("user_id") % 50).cast("double").alias("rpm"), (5 + F.col("user_id") % 20).alias("burst"))


@query("h16_effective_limits", sql=_MULT + f""", {_LIMITS}, x AS (SELECT m.host, m.m, coalesce(l.rpm, 60.0::DOUBLE) AS rpm, coalesce(l.burst, 20) AS burst FROM m LEFT JOIN l ON l.host = m.host)
  SELECT host, round(CASE WHEN m >= 1 THEN rpm ELSE greatest(rpm * m, 0.01::DOUBLE) END, 9) AS rpm, CASE WHEN m >= 1 THEN burst ELSE greatest(floor(round(burst * m, 9)), 1) END::BIGINT AS burst FROM x""")
def _(t):
    e = Hh.effective_limits(Hh.rate_multiplier(fx.outcomes(t)), _limits(t))
    return e.select("host", F.round("rpm", 9).alias("rpm"), "burst")


def _bucket(t):
    """Stored requests packed 2000 times closer, so that buckets do run empty."""
    r = fx.outcomes(t).select("host", F.col("id").alias("req_id"), F.timestamp_micros(F.floor(F.unix_micros("ts") / 2000)).alias("ts"))
    return Hh.replay_bucket(r, _limits(t).withColumn("rpm", F.col("rpm") / 10).withColumn("burst", F.col("burst") / 5))


_SPEND = f"""WITH RECURSIVE {q.OUTCOMES}, {_LIMITS}, o AS (SELECT c.host, c.id, floor(epoch_us(c.ts) / 2000)::BIGINT AS us, coalesce(l.rpm / 10, 60.0)::DOUBLE AS rpm, coalesce(l.burst / 5, 20.0)::DOUBLE AS burst,
    row_number() OVER (PARTITION BY c.host ORDER BY c.ts, c.id) AS rn FROM outcomes c LEFT JOIN l ON l.host = c.host),
  w AS (SELECT host, rn - 1 AS rn, id, us, burst AS tokens, us / 1e6::DOUBLE AS last, []::DOUBLE[] AS recent, true AS admitted FROM o WHERE rn = 1
    UNION ALL SELECT host, rn, id, us, CASE WHEN tk >= 1 OR len(rc) < rpm THEN tk - 1 ELSE tk END, now, CASE WHEN tk >= 1 OR len(rc) < rpm THEN list_append(rc, now) ELSE rc END, tk >= 1 OR len(rc) < rpm
    FROM (SELECT o.host, o.rn, o.id, o.us, o.rpm, o.us / 1e6::DOUBLE AS now, least(w.tokens + (o.us / 1e6::DOUBLE - w.last) * o.rpm / 60.0::DOUBLE, o.burst) AS tk,
      list_filter(w.recent, lambda x: x >= o.us / 1e6::DOUBLE - 60.0::DOUBLE) AS rc FROM w JOIN o ON o.host = w.host AND o.rn = w.rn + 1)),
  r AS (SELECT * FROM w WHERE rn > 0)"""


@query("h17_token_bucket", sql=_SPEND + " SELECT host, id AS req_id, admitted, round(tokens, 6) AS tokens, len(recent) AS in_window, us AS ts FROM r")
def _(t):
    return _bucket(t).withColumn("tokens", F.round("tokens", 6))


@query("h18_limiter_stats", sql=_SPEND + f""" SELECT host, count(*) FILTER (admitted) AS total_requests, count(*) FILTER (NOT admitted) AS blocked_count,
  count(*) FILTER (admitted AND us >= floor(epoch_us({_AS_OF}) / 2000)::BIGINT - 60000000) AS requests_in_window FROM r GROUP BY 1""")
def _(t):
    last = F.timestamp_micros(F.floor(F.unix_micros(_as_of()) / 2000))
    return Hh.limiter_stats(_bucket(t), last)


@query("h19_outcome_history", sql=f"WITH {q.OUTCOMES} SELECT host, id, ok FROM outcomes QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, id DESC) <= 20")
def _(t):
    return Hh.outcome_history(fx.outcomes(t), n=20).select("host", "id", "ok")


_ENGINES = "['bing', 'brave', 'duckduckgo'][1 + user_id % 3]"
_EMA = f"""WITH e AS (SELECT {_ENGINES} AS engine, event_id, ts, event_type <> 'error' AS ok, value FROM events),
  g AS (SELECT engine, list({{'ok': ok::INT::DOUBLE, 'l': value::DOUBLE}} ORDER BY ts, event_id) AS xs, count(*) AS attempts, count(*) FILTER (ok) AS successes, max(ts) AS last_ts, max(ts) FILTER (ok) AS last_ok FROM e GROUP BY 1),
  s AS (SELECT engine, attempts, successes, last_ts, (SELECT count(*) FROM e WHERE e.engine = g.engine AND e.ts > coalesce(g.last_ok, TIMESTAMP '1970-01-01')) AS trail,
    list_reduce(list_transform(xs, lambda x: x.ok), lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE, CASE WHEN engine = 'bing' THEN 0.90 ELSE 0.88 END::DOUBLE) AS success_ema,
    list_reduce(list_transform(xs, lambda x: x.l), lambda a, x: a * 0.7::DOUBLE + greatest(x, 0) * 0.3::DOUBLE, CASE WHEN engine = 'bing' THEN 1800 ELSE 1900 END::DOUBLE) AS latency_ema FROM g),
  sc AS (SELECT *, round(greatest(0.0, success_ema * 100 - least(latency_ema, 15000.0) / 300), 2) AS score, greatest(0.0, (epoch_us(last_ts) + 30000000 - epoch_us({_AS_OF})) / 1000000.0) AS rest FROM s)"""


def _states(t):
    e = t("events").select(
        F.element_at(F.array(*[F.lit(n) for n in fixed.ENGINE_PRIORS]), (F.col("user_id") % 3 + 1).cast("int")).alias("engine"), F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"), F.lit("timeout").alias("code"))
    return Hh.health_states(e, priors=fixed.ENGINE_PRIORS, error="code")


@query("h20_engine_averages", sql=_EMA + " SELECT engine, attempts, successes, round(success_ema, 6) AS success_ema, round(latency_ema, 6) AS latency_ema FROM s")
def _(t):
    return _states(t).select("engine", "attempts", "successes", F.round("success_ema", 6).alias("success_ema"), F.round("latency_ema_ms", 6).alias("latency_ema"))


@query("h21_engine_score", sql=_EMA + " SELECT engine, score FROM sc")
def _(t):
    return _states(t).select("engine", Hh.engine_score("success_ema", "latency_ema_ms").alias("score"))


@query("h22_engine_selection", sql=_EMA + " SELECT engine, score FROM sc WHERE NOT (trail >= 2 AND rest > 0) ORDER BY score DESC, engine LIMIT 1")
def _(t):
    return Hh.select_engines(Hh.engine_snapshot(_states(t), _as_of()), fallback=False).select("engine", "score")


@query("h23_engine_snapshot", sql=_EMA + """ SELECT engine, CASE WHEN trail >= 2 AND rest > 0 THEN 'open' WHEN attempts = 0 THEN 'untried' WHEN trail > 0 THEN 'degraded' ELSE 'healthy' END AS status, score, attempts, successes, trail AS consecutive_failures FROM sc""")
def _(t):
    return Hh.engine_snapshot(_states(t), _as_of()).select("engine", "status", "score", "attempts", "successes", "consecutive_failures")


@query("h24_endpoint_cooldown", sql=f"""WITH {q.OUTCOMES}, g AS (SELECT host, max(ts) AS last_ts, max(ts) FILTER (ok) AS last_ok, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures FROM outcomes GROUP BY 1),
  c AS (SELECT g.host, g.last_ts, g.successes, g.failures, count(*) FILTER (o.ts > coalesce(g.last_ok, TIMESTAMP '1970-01-01')) AS trail FROM g JOIN outcomes o ON o.host = g.host GROUP BY ALL)
  SELECT host, successes, failures, trail AS consecutive_failures, CASE WHEN trail >= 2 THEN greatest(0.0::DOUBLE, (epoch_us(last_ts) + 600000000000 - epoch_us({_AS_OF})) / 1000000.0::DOUBLE) ELSE 0.0::DOUBLE END AS cooldown FROM c""")
def _(t):
    # two failures and a week of rest on these sparse logs
    s = Hh.health_states(fx.outcomes(t), key="host")
    r = Hh.cooldown_left(s, _as_of(), 2, 600000.0, "cooldown")
    return r.select("host", "successes", (F.col("attempts") - F.col("successes")).alias("failures"), "consecutive_failures", "cooldown")


_IDENT = "sha256('proxy-endpoint-v1' || chr(0) || 'http://p' || n_nationkey || ':80' || chr(0) || CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END)"


def _endpoints(t):
    server = F.concat(F.lit("http://p"), F.col("n_nationkey").cast("string"), F.lit(":80"))
    return t("nation").select("n_nationkey", server.alias("server"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("username")).withColumn("identity", Hh.endpoint_identity("server", "username"))


@query("h25_rendezvous", sql=f"""WITH ep AS (SELECT {_IDENT} AS identity FROM nation), k AS (SELECT DISTINCT user_id FROM events)
  SELECT user_id, max_by(identity, sha256(user_id::VARCHAR || chr(0) || identity)) AS endpoint FROM k, ep GROUP BY 1""")
def _(t):
    return Hh.rendezvous(t("events").select("user_id").distinct(), "user_id", _endpoints(t))


@query("h26_round_robin", sql=f"""WITH ep AS (SELECT identity, row_number() OVER (ORDER BY identity) - 1 AS i FROM (SELECT DISTINCT {_IDENT} AS identity FROM nation)), r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events)
  SELECT event_id, identity AS endpoint FROM r JOIN ep ON r.pos % (SELECT count(*) FROM ep) = ep.i""")
def _(t):
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return Hh.round_robin(e, "ts", _endpoints(t), ties=["event_id"]).select("event_id", "endpoint")


@query("h27_endpoint_identity", sql=f"SELECT n_nationkey::BIGINT AS n_nationkey, {_IDENT} AS identity, 'proxy-' || substr({_IDENT}, 1, 16) AS public_identity FROM nation")
def _(t):
    return _endpoints(t).select("n_nationkey", "identity", Hh.public_identity("server", "username").alias("public_identity"))


@query("p5_host_limits", sql=f"WITH h AS (SELECT DISTINCT 'h' || user_id AS host FROM events), {_LIMITS} SELECT h.host, coalesce(l.rpm, 60.0::DOUBLE) AS rpm, coalesce(l.burst, 20)::BIGINT AS burst FROM h LEFT JOIN l ON l.host = h.host")
def _(t):
    hosts = fx.outcomes(t).select("host").distinct().withColumn("multiplier", F.lit(1.0))
    return Hh.effective_limits(hosts, _limits(t)).select("host", "rpm", "burst")
