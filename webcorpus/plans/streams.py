"""Queries: the streaming jobs, run once over all stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H, urls as U
from ..sources import sinks
from ..streaming import jobs as S
from . import fixtures as fx, sqltext as q
from .hosts import _MULT, _WALK
from .registry import query
from .watching import _TRACKED


class _Streamed:
    """Tables whose reads are streams, so the fixtures build stream inputs."""

    def __init__(self, t):
        self.t = t

    def __call__(self, name):
        return self.t.stream(name)


@query("a7_document_stream", sql="""WITH p AS (SELECT page_id, url, contains(html, '</body>') AS whole FROM pages)
  SELECT 'document' AS event, CAST(json_object('page_id', page_id, 'url', url) AS VARCHAR) AS data FROM p WHERE whole
  UNION ALL SELECT 'done', '{"completed":' || count(*) FILTER (whole) || ',"errors":' || count(*) FILTER (NOT whole) || '}' FROM p""")
def _(t):
    # pages that end are documents, cut ones are errors: a row each, then one summary
    whole = F.col("html").contains("</body>")
    return sinks.documents_and_summary(t("pages").filter(whole).select("page_id", "url"), t("pages").filter(~whole).select("page_id"))


@query("o1_page_stream", sql=f"SELECT page_id, {q.normalize('url')} AS url, {q.plain_text(q.clean('html'))} AS text, len({q.hrefs(q.clean('html'))}) AS links FROM pages")
def _(t):
    return S.run_to_table(S.page_stream(t.stream("pages")), "pages").select("page_id", "url", "text", "links")


@query("o2_stream_dedup", sql=f"SELECT {q.content_hash('text')} AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return S.dedup_to_table(t.stream("documents").select("doc_id", "text"), "text", "doc_id", "dedup").select("hash", "doc_id")


@query("o3_progress", sql="SELECT sum((page_id % 9 <> 0)::INT)::BIGINT AS completed, sum((page_id % 9 = 0)::INT)::BIGINT AS errors FROM pages")
def _(t):
    p = t.stream("pages").select("page_id", F.when(F.col("page_id") % 9 == 0, "failed").alias("error"))
    return S.progress(p, "error").agg(F.sum("completed").alias("completed"), F.sum("errors").alias("errors"))


@query("o4_watch_changes", sql=_TRACKED + """ SELECT url, version, changed, sum(changed::INT) OVER (PARTITION BY url ORDER BY version)::BIGINT AS change_count FROM tracked""")
def _(t):
    d = t.stream("documents").select(F.col("source").alias("url"), F.timestamp_seconds(F.col("doc_id")).alias("ts"), "text")
    return S.run_to_table(S.watch_changes(d), "watch").select("url", F.unix_seconds("ts").alias("version"), "changed", "change_count")


@query("o5_live_breaker", sql=_WALK + """ SELECT host, id AS call_id, t AS event_us, 'start' AS kind, admitted, st1 AS state, run1 AS run FROM r
  UNION ALL SELECT host, id, t, 'end', true, st2, run2 FROM r WHERE admitted""")
def _(t):
    return S.run_to_table(S.breaker(fx.calls(_Streamed(t)), 2, 7200.0), "breaker").drop("since_us")


_MIN = "CASE event_type WHEN 'error' THEN 500 ELSE 200 END"


@query("o6_live_metrics", sql=f"""SELECT minute, endpoint, count(*) AS count, round(sum(value), 4) AS latency_ms_sum, count(*) FILTER ({_MIN} = 200) AS success_count
  FROM (SELECT epoch_us(ts) // 60000000 * 60000000 AS minute, upper(event_type) || ' /v1/x' AS endpoint, value, event_type FROM events) GROUP BY minute, endpoint""")
def _(t):
    e = t.stream("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("method"), F.lit("/v1/x").alias("path"), F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    return S.run_to_keyed_table(S.endpoint_metrics(e), "metrics", ["minute", "endpoint"]).withColumn("latency_ms_sum", F.round("latency_ms_sum", 4))


@query("o7_live_failure_rate", sql=f"""WITH {q.OUTCOMES}, w AS (SELECT host, ok, unnest(range(epoch_us(ts) // 30000000 - 3, epoch_us(ts) // 30000000 + 1)) * 30000000 AS start FROM outcomes)
  SELECT start, host, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, round(count(*) FILTER (NOT ok) / count(*), 6) AS failure_rate FROM w GROUP BY start, host""")
def _(t):
    return S.run_to_keyed_table(S.failure_rates(fx.outcomes(_Streamed(t))), "rates", ["start", "host"]).withColumn("failure_rate", F.round("failure_rate", 6))


@query("o8_live_multiplier", sql=_MULT + " SELECT host, round(m, 9) AS multiplier FROM m")
def _(t):
    rows = S.run_to_table(S.rate_multipliers(fx.outcomes(_Streamed(t))), "multiplier")
    last = rows.groupBy("host").agg(F.max_by("multiplier", F.struct("ts", "id")).alias("m"))
    return last.select("host", F.round("m", 9).alias("multiplier"))


@query("o9_expirations", sql="""WITH s AS (SELECT user_id::VARCHAR AS key, max_by(event_id, ts) AS event_id, max(epoch_us(ts)) AS stored_us FROM events GROUP BY 1), x AS (SELECT key, stored_us, stored_us + (600 + event_id % 5 * 3000) * 1000000 AS expires_us FROM s)
  SELECT key, stored_us, expires_us FROM x WHERE expires_us // 1000 + 1 < (SELECT max(epoch_us(ts)) // 1000 FROM events)""")
def _(t):
    e = t.stream("events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("stored_at"), (600 + F.col("event_id") % 5 * 3000).cast("double").alias("ttl"))
    return S.run_to_table(S.expirations(e), "expire")


@query("o10_ndjson_sink", sql="SELECT page_id, url FROM pages")
def _(t):
    from ..session import stream_dir

    out = stream_dir(t.spark, "ndjson-out")
    S.write_ndjson(t.stream("pages").select("page_id", "url"), out).awaitTermination()
    return t.spark.read.schema("page_id long, url string").json(out)


@query("p2_page_hook", sql="SELECT count(*) AS pages, sum(length(url))::BIGINT AS chars FROM pages")
def _(t):
    from ..session import stream_dir

    out = stream_dir(t.spark, "hook-out")

    def hook(batch, epoch):
        batch.agg(F.count("*").alias("pages"), F.sum(F.length("url")).alias("chars")).write.mode("append").parquet(out)

    S.for_each_page(t.stream("pages").select("url"), hook).awaitTermination()
    return t.spark.read.schema("pages long, chars long").parquet(out).agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"))
