"""Queries: change detection, freshness, selector memory and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X, urls as U
from ..operators import changes as C, freshness as J, logs as L, selectors as K
from ..operators.segments import top_k
from . import fixtures as fx, sqltext as q
from .registry import query

WIDTH = 1000  # versions per segment of a watched source
_NOTED = "text || ' see http://x.org/a?b=' || doc_id || ' on 12/05/2024 at 9:30pm'"


@query("g1_normalize_for_diff", sql=f"SELECT doc_id, {q.diff_norm(_NOTED)} AS norm FROM documents")
def _(t):
    noted = F.concat("text", F.lit(" see http://x.org/a?b="), F.col("doc_id").cast("string"), F.lit(" on 12/05/2024 at 9:30pm"))
    return t("documents").select("doc_id", X.normalize_for_diff(noted).alias("norm"))


@query("g2_change_hash", sql=f"SELECT doc_id, sha256({q.diff_norm('text')}) AS h FROM documents")
def _(t):
    return t("documents").select("doc_id", X.change_hash("text").alias("h"))


_TRACKED = f"""WITH h AS (SELECT source AS url, doc_id AS version, text, {q.change_hash('text')} AS current_hash FROM documents),
  p AS (SELECT *, lag(current_hash) OVER w AS previous_hash, lag(text) OVER w AS previous_text FROM h WINDOW w AS (PARTITION BY url ORDER BY version)),
  tracked AS (SELECT *, previous_hash IS NOT NULL AND previous_hash <> current_hash AS changed FROM p)"""


def _tracked(t, keep_text=False, keep_sentences=False):
    return C.track(fx.snapshots(t), "url", "version", "text", WIDTH, keep_text, keep_sentences=keep_sentences)


@query("g3_track_changes", sql=_TRACKED + " SELECT url, version, previous_hash, current_hash, changed FROM tracked")
def _(t):
    return _tracked(t).select("url", "version", "previous_hash", "current_hash", "changed")


@query("g4_split_sentences", sql=f"SELECT doc_id, len({q.sentences('text')}) AS n, sha256(array_to_string({q.sentences('text')}, '|')) AS h FROM documents")
def _(t):
    s = X.split_sentences("text")
    return t("documents").select("doc_id", F.size(s).alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("h"))


@query("g5_normalize_sentence", sql=f"SELECT doc_id, array_to_string(list_transform({q.sentences('text')}, lambda s: {q.norm_sentence('s')}), '|') AS norm FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(F.transform(X.split_sentences("text"), X.normalize_sentence), "|").alias("norm"))


_DIFFED = _TRACKED + f""", sets AS (SELECT *, {q.sentence_set('previous_text')} AS o, {q.sentence_set('text')} AS n FROM tracked WHERE changed),
  diffed AS (SELECT url, version, current_hash, list_concat(
    list_transform(list_sort(list_filter(n, lambda s: length(s) > 20 AND NOT list_contains(o, s))), lambda s: '+ Added: ' || s),
    list_transform(list_sort(list_filter(o, lambda s: length(s) > 20 AND NOT list_contains(n, s))), lambda s: '- Removed: ' || s))[1:50] AS changes FROM sets)"""


def _diffed(t):
    return C.sentence_diffs(_tracked(t, keep_sentences=True))


@query("g6_sentence_diff", sql=_DIFFED + " SELECT url, version, len(changes) AS n, array_to_string(changes, chr(10)) AS changes FROM diffed")
def _(t):
    return _diffed(t).filter("changed").select("url", "version", F.size("changes").alias("n"), F.array_join("changes", "\n").alias("changes"))


@query("g7_unified_diff")
def _(t):
    return C.unified_diffs(_tracked(t, keep_text=True)).select("url", "version", "diff")


@query("g8_keep_last", sql="SELECT url, version FROM (SELECT source AS url, doc_id AS version, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 10")
def _(t):
    return C.keep_last(fx.snapshots(t).select("url", "version"), "url", "version")


@query("g9_watch_status", sql=_TRACKED + """ SELECT url, least(count(*), 10) AS snapshot_count, count(*) FILTER (changed) AS change_count, max(version) AS last_check,
  max(version) FILTER (changed) AS last_change, max_by(current_hash, version) AS latest_hash FROM tracked GROUP BY 1""")
def _(t):
    return C.watch_status(_tracked(t), "url", "version")


@query("g10_change_events", sql=_DIFFED + f""" SELECT url, {q.domain('url')} AS domain, row_number() OVER (PARTITION BY url ORDER BY version) AS change_count, len(changes) AS change_count_this_watch,
  array_to_string(changes[1:20], chr(10)) AS changes, current_hash AS content_hash, version AS detected_at FROM diffed""")
def _(t):
    return C.change_events(_diffed(t), "url", "version", WIDTH).withColumn("changes", F.array_join("changes", "\n"))


@query("g11_register_watches", sql="""WITH c AS (SELECT c_name AS url, c_mktsegment AS hook, true AS enabled FROM customer WHERE c_custkey % 3 <> 0),
  u AS (SELECT c_name AS url, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'hook' || c_custkey END AS hook, c_custkey FROM customer WHERE c_custkey % 5 <> 0)
  SELECT coalesce(c.url, u.url) AS url, 'unknown' AS domain, coalesce(nullif(u.hook, ''), c.hook) AS webhook_url, CASE WHEN u.url IS NOT NULL THEN 'main' ELSE '.old' END AS selectors, true AS enabled FROM c FULL JOIN u ON c.url = u.url""")
def _(t):
    c = t("customer")
    current = c.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("url"), F.col("c_mktsegment").alias("webhook_url"), F.array(F.lit(".old")).alias("selectors"), (F.col("c_custkey") % 7 != 0).alias("enabled"))
    new = c.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("url"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("hook"), F.col("c_custkey").cast("string"))).alias("webhook_url"), F.array(F.lit("main")).alias("selectors"))
    return C.register_watches(current.withColumn("enabled", F.lit(True)), new).withColumn("selectors", F.array_join("selectors", ","))


@query("g12_unwatch", sql="SELECT DISTINCT source AS url FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND doc_id % 10 = 0)")
def _(t):
    d = t("documents")
    return C.unwatch(d.select(F.col("source").alias("url")).distinct(), d.filter("lang = 'es' AND doc_id % 10 = 0").select(F.col("source").alias("url")).distinct())


@query("g13_history", sql=_TRACKED + """, last AS (SELECT * FROM tracked QUALIFY row_number() OVER (PARTITION BY url ORDER BY version DESC) <= 10)
  SELECT url, string_agg(version || ':' || current_hash || ':' || changed, ',' ORDER BY version) AS history FROM last GROUP BY 1""")
def _(t):
    h = C.history(_tracked(t), "url", "version")
    item = F.transform("history", lambda x: F.concat_ws(":", x["created_at"].cast("string"), x["content_hash"], x["changed"].cast("string")))
    return h.select("url", F.array_join(item, ",").alias("history"))


@query("g14_tracker_stats", sql="SELECT count(DISTINCT source) AS tracked_urls FROM documents")
def _(t):
    return C.tracker_stats(fx.snapshots(t))


# ---- logs and jobs -----------------------------------------------------------------------

@query("i1_endpoint_stats", sql="""WITH r AS (SELECT upper(event_type) || ' /v1/' || CASE WHEN event_id % 2 = 0 THEN 'jobs/{id}' ELSE 'scrape' END AS endpoint, value AS l, CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 302 ELSE 200 END AS s FROM events)
  SELECT endpoint, count(*) AS count, round(avg(l), 3) AS avg_latency_ms, round(avg(CASE WHEN s BETWEEN 200 AND 399 THEN 1.0 ELSE 0.0 END), 4) AS success_rate FROM r GROUP BY 1""")
def _(t):
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/v1/jobs/"), (F.col("event_id") + 100000000).cast("string"), F.lit("/"))).otherwise("/v1/scrape")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 302).otherwise(200)
    return L.endpoint_stats(t("events").select(F.col("event_type").alias("method"), path.alias("path"), status.alias("status"), F.col("value").alias("latency_ms")))


_LOG = "(SELECT event_id AS id, 'u' || user_id AS url, event_type AS method, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS duration_ms, ts AS created_at FROM events)"


def _log(t):
    return t("events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("method"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("value").alias("duration_ms"), F.col("ts").cast("timestamp").alias("created_at"))


@query("i2_list_log", sql=f"SELECT id, url, method, status, epoch_us(created_at) AS created_at FROM {_LOG} WHERE status = 'success' AND method = 'click' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20")
def _(t):
    return L.list_rows(_log(t), 50, 20, status="success", method="click", url=None).select("id", "url", "method", "status", "created_at")


@query("i3_get_log", sql=f"SELECT id, url, method, status FROM {_LOG} WHERE id = 42")
def _(t):
    return L.get_row(_log(t), 42).select("id", "url", "method", "status")


@query("i4_log_stats", sql=f"""SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(method) = 0 THEN 'method' ELSE 'total' END AS kind, coalesce(status, method, 'all') AS value, count(*) AS n
  FROM {_LOG} GROUP BY GROUPING SETS ((status), (method), ())""")
def _(t):
    return L.log_stats(_log(t))


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


@query("i5_retention", sql=f"SELECT count(*) FILTER (created_at >= {_NOW} - INTERVAL 168 HOUR) AS kept, count(*) FILTER (created_at < {_NOW} - INTERVAL 168 HOUR) AS deleted FROM {_LOG}")
def _(t):
    return L.retention_counts(_log(t), _now())


_JOBS = "(SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL 24 HOUR END AS expires_at FROM orders)"


def _jobs(t):
    made = F.col("o_orderdate").cast("timestamp")
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), made.alias("created_at"),
                              F.when(F.col("o_orderkey") % 4 != 0, made + F.expr("interval 24 hours")).alias("expires_at"))


@query("i6_list_jobs", sql=f"SELECT id, status, epoch_us(created_at) AS created_at FROM {_JOBS} WHERE status = 'F' ORDER BY created_at DESC, id DESC LIMIT 50")
def _(t):
    return L.list_rows(_jobs(t), 50, status="F").select("id", "status", "created_at")


@query("i7_live_jobs", sql=f"SELECT id, status FROM {_JOBS} WHERE NOT coalesce(expires_at < TIMESTAMP '1996-06-01', false)")
def _(t):
    return L.live_jobs(_jobs(t), F.lit("1996-06-01").cast("timestamp")).select("id", "status")


@query("i8_due_schedules", sql=f"SELECT id FROM {_JOBS} WHERE status <> 'P' AND expires_at IS NOT NULL AND expires_at <= TIMESTAMP '1996-06-01'")
def _(t):
    s = _jobs(t).select("id", (F.col("status") != "P").alias("enabled"), F.col("expires_at").alias("next_run"))
    return L.due_schedules(s, F.lit("1996-06-01").cast("timestamp")).select("id")


@query("i9_next_run", sql="SELECT o_orderkey AS id, epoch_us(TIMESTAMP '1996-06-01') + coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey * 60 END, 0) * 1000000 AS next_run FROM orders")
def _(t):
    every = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") * 60)
    return t("orders").select(F.col("o_orderkey").alias("id"), L.next_run(F.lit("1996-06-01").cast("timestamp"), every).alias("next_run"))


@query("i10_job_age", sql=f"SELECT id, ((epoch_us({_NOW}) - epoch_us(created_at)) // 1000000)::BIGINT AS age FROM {_JOBS}")
def _(t):
    return _jobs(t).select("id", L.age_seconds(_now(), F.col("created_at")).alias("age"))


_BATCH = f"""WITH r AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN replace(url, 'http', 'ftp') ELSE url END AS url FROM pages),
  oh AS (SELECT DISTINCT {q.domain('url')} AS host FROM pages WHERE page_id % 17 = 0), ca AS (SELECT DISTINCT url FROM pages WHERE page_id % 5 = 0),
  fe AS (SELECT url, CASE page_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status FROM pages WHERE page_id % 7 <> 0),
  j AS (SELECT r.url, {q.domain('r.url')} AS host, NOT starts_with(r.url, 'ftp') AS valid, oh.host IS NOT NULL AS is_open, ca.url IS NOT NULL AS is_cached,
    CASE WHEN fe.url IS NULL THEN 500 WHEN fe.status >= 400 THEN fe.status END AS bad, fe.url IS NULL AS missing
    FROM r LEFT JOIN oh ON oh.host = {q.domain('r.url')} LEFT JOIN ca ON ca.url = r.url LEFT JOIN fe ON fe.url = r.url),
  b AS (SELECT url, CASE WHEN NOT valid THEN 'invalid_url' WHEN is_open THEN 'circuit_open' WHEN is_cached THEN NULL WHEN bad = 404 THEN 'not_found' WHEN bad = 503 THEN 'service_unavailable' WHEN bad = 500 THEN 'internal_error' END AS error_code,
    CASE WHEN NOT valid THEN 'Invalid URL (bad scheme or missing host): ' || url WHEN is_open THEN 'Circuit breaker open for ' || host WHEN is_cached THEN NULL WHEN missing THEN 'Scraper returned no data' WHEN bad IS NOT NULL THEN 'Upstream returned HTTP ' || bad END AS error,
    valid AND NOT is_open AND is_cached AS cached FROM j)"""


def _batch(t):
    p = t("pages").select("page_id", "url")
    req = p.select(F.when(F.col("page_id") % 11 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url")).alias("url"))
    status = F.when(F.col("page_id") % 4 == 0, 404).when(F.col("page_id") % 4 == 1, 503).otherwise(200)
    return L.batch_outcomes(
        req, p.filter("page_id % 17 = 0").select(U.domain("url").alias("host")), p.filter("page_id % 5 = 0").select("url"),
        p.filter("page_id % 7 <> 0").select("url", status.alias("status"), F.lit(None).cast("string").alias("error")))


@query("i11_batch_outcomes", sql=_BATCH + " SELECT url, error_code IS NULL AS success, error_code, error, cached FROM b")
def _(t):
    return _batch(t)


@query("i12_batch_summary", sql=_BATCH + """ SELECT count(*) AS total, count(*) FILTER (error_code IS NULL) AS success_count, count(*) FILTER (error_code IS NULL) BETWEEN 1 AND count(*) - 1 AS partial,
  count(*) FILTER (error_code IS NULL) > 0 AS success, count(*) FILTER (error_code IN ('invalid_url', 'circuit_open')) AS warnings FROM b""")
def _(t):
    return L.batch_summary(_batch(t))


@query("i13_job_status", sql="SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'failed' ELSE 'completed' END AS status FROM orders")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "boom").alias("error"), (F.col("o_orderstatus") == "F").alias("success"))
    return o.select("id", L.job_status("error", "success").alias("status"))


@query("i14_search_failures", sql="""SELECT user_id AS query, CASE WHEN count(code) > 0 AND bool_and(code = 'circuit_open') THEN 'circuit_open' ELSE 'search_engines_unavailable' END AS error_code
  FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 AND event_type <> 'error' THEN NULL WHEN user_id % 3 = 0 THEN 'timeout' ELSE 'circuit_open' END AS code FROM events) GROUP BY 1""")
def _(t):
    code = F.when((F.col("user_id") % 2 == 0) & (F.col("event_type") != "error"), F.lit(None).cast("string")).when(F.col("user_id") % 3 == 0, "timeout").otherwise("circuit_open")
    return L.search_failures(t("events").select(F.col("user_id").alias("query"), code.alias("error_code")))


# ---- freshness ---------------------------------------------------------------------------

@query("j1_cache_key", sql="""SELECT page_id, sha256('{' || CASE WHEN page_id % 2 = 0 THEN '"extra":{"mobile":true,"wait":' || page_id || '},' ELSE '"extra":{"mobile":true},' END
  || '"formats":["LINKS","MARKDOWN"],"url":"' || lower(trim(url)) || '"}') AS key FROM pages""")
def _(t):
    extra = {"wait": F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")), "mobile": F.lit("true")}
    return t("pages").select("page_id", J.cache_key("url", F.array(F.lit("MARKDOWN"), F.lit("LINKS")), extra).alias("key"))


_STORED = "stored AS (SELECT user_id AS key, ts AS stored_at, (600 + event_id % 5 * 3000)::DOUBLE AS ttl, event_id FROM events WHERE event_type = 'purchase')"


def _stored(t):
    e = t("events").filter("event_type = 'purchase'")
    return e.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("stored_at"), (600 + F.col("event_id") % 5 * 3000).cast("double").alias("ttl"), "event_id")


@query("j2_ttl_lookup", sql=f"""WITH {_STORED}, req AS (SELECT user_id AS key, event_id AS req_id, ts AS req_ts FROM events WHERE event_type = 'view'),
  a AS (SELECT req.key, req.req_id, req.req_ts, s.stored_at, s.ttl FROM req ASOF LEFT JOIN stored s ON req.key = s.key AND req.req_ts >= s.stored_at)
  SELECT key, req_id, epoch_us(req_ts) AS req_ts, coalesce(epoch_us(req_ts) <= epoch_us(stored_at) + ttl * 1000000, false) AS hit,
    CASE WHEN coalesce(epoch_us(req_ts) <= epoch_us(stored_at) + ttl * 1000000, false) THEN epoch_us(stored_at) END AS stored_at FROM a""")
def _(t):
    req = t("events").filter("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("req_id"), F.col("ts").cast("timestamp").alias("req_ts"))
    return J.lookup(req, _stored(t))


@query("j3_keep_newest", sql=f"WITH {_STORED} SELECT event_id, key FROM stored ORDER BY stored_at DESC, event_id DESC LIMIT 500")
def _(t):
    return J.keep_newest(_stored(t), 500, tie="event_id").select("event_id", "key")


@query("j4_invalidate", sql=f"WITH {_STORED} SELECT event_id, key FROM stored WHERE key NOT IN (SELECT user_id FROM events WHERE event_id % 40 = 0)")
def _(t):
    gone = t("events").filter("event_id % 40 = 0").select(F.col("user_id").alias("key"))
    return J.invalidate(_stored(t), gone, "key").select("event_id", "key")


@query("j5_cache_stats", sql=f"WITH {_STORED} SELECT count(*) AS entries, count(*) FILTER (epoch_us({_NOW}) > epoch_us(stored_at) + ttl * 1000000) AS expired FROM stored")
def _(t):
    return J.stats(_stored(t), _now())


@query("j6_cacheable", sql="SELECT event_id, NOT (event_type = 'click' OR user_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0) AS cacheable FROM events")
def _(t):
    none = F.array().cast("array<string>")
    return t("events").select("event_id", J.is_cacheable(
        F.when(F.col("event_type") == "click", F.array(F.lit("click"))).otherwise(none),
        F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("b"))), none,
        F.col("event_id") % 5 == 0, F.lit(None).cast("boolean"), F.when(F.col("event_id") % 7 == 0, "{}")).alias("cacheable"))


# ---- selector memory ---------------------------------------------------------------------

_USES = "uses AS (SELECT 'u' || user_id AS url, event_type AS selector, count(*) AS count, max(ts) AS last_used FROM events WHERE event_id % 13 <> 0 GROUP BY 1, 2)"


def _uses(t):
    sel = F.when(F.col("event_id") % 13 == 0, "   ").otherwise(F.concat(F.lit(" "), "event_type"))
    return K.uses(t("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), sel.alias("selector"), F.col("ts").cast("timestamp").alias("ts")))


@query("k1_selector_uses", sql=f"WITH {_USES} SELECT url, selector, count, epoch_us(last_used) AS last_used FROM uses")
def _(t):
    return _uses(t)


_K_NOW = "TIMESTAMP '2024-01-30 12:00:00'"
_SCORED = f"""scored AS (SELECT url, selector, count * CASE WHEN epoch_us({_K_NOW}) - epoch_us(last_used) < 3600000000 THEN 1.0::DOUBLE WHEN epoch_us({_K_NOW}) - epoch_us(last_used) < 86400000000 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS score FROM uses),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, selector) AS rank FROM scored)"""


def _k_now():
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


@query("k2_suggestions", sql=f"WITH {_USES}, {_SCORED} SELECT url, selector, round(score, 4) AS score, rank FROM ranked WHERE rank <= 3")
def _(t):
    return K.suggestions(_uses(t), _k_now(), 3).withColumn("score", F.round("score", 4))


@query("k3_selector_caps", sql=f"""WITH {_USES}, b AS (SELECT * FROM uses QUALIFY row_number() OVER (PARTITION BY url ORDER BY count DESC, last_used DESC, selector) <= 3),
  u AS (SELECT url FROM b GROUP BY 1 ORDER BY max(last_used) DESC, url LIMIT 50) SELECT url, selector, count FROM b WHERE url IN (SELECT url FROM u)""")
def _(t):
    return K.capped(_uses(t), 3, 50).select("url", "selector", "count")


@query("k4_selector_stats", sql=f"WITH {_USES} SELECT url, string_agg(selector || '=' || count, ',' ORDER BY selector) AS selectors FROM uses GROUP BY 1")
def _(t):
    m = K.counters(K.capped(_uses(t), urls=1_000_000_000))
    items = F.transform(F.map_entries("selectors"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("url", F.array_join(F.array_sort(items), ",").alias("selectors"))


@query("k5_forget", sql=f"WITH {_USES} SELECT url, selector FROM uses WHERE NOT (substr(url, 2)::INT % 10 = 0) AND NOT (selector = 'click' AND substr(url, 2)::INT % 3 = 0)")
def _(t):
    u = t("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), "user_id").distinct()
    gone = u.filter("user_id % 10 = 0").select("url", F.lit(None).cast("string").alias("selector")).unionByName(
        u.filter("user_id % 3 = 0").select("url", F.lit("click").alias("selector")))
    return K.forget(_uses(t), gone).select("url", "selector")


@query("k6_hints", sql=f"WITH {_USES}, {_SCORED} SELECT url, selector, round(score, 2) AS score FROM ranked WHERE rank <= 3")
def _(t):
    return K.hints(_uses(t), _k_now())
