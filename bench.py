"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_REPEAT (default 2: the first run warms
up, the best counts).
Every query is materialised completely (noop sink). ``pages_per_sec`` compares with the
published crawl throughput: pages of a crawl over stored pages, and parsed pages.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_host_report", "c1_normalize_url", "c4_resolve_links", "d13_noise_elements", "d17_plain_text", "d18_markdown", "e2_keep_first", "f3_reach", "f5_crawl",
    "f7_robots_allowed", "f11_site_map", "g6_sentence_diff", "g9_watch_status", "h10_breaker_replay", "h13_failure_runs", "h14_failure_rate", "h15_rate_multiplier",
    "h17_token_bucket", "h20_engine_averages", "i1_endpoint_stats", "i4_log_stats", "j2_ttl_lookup", "k2_suggestions", "l1_page_budget", "l9_schema_confidence",
    "m3_relevance", "m5_relevant_quote", "m16_unanswered", "n1_chunks", "n4_nearest", "o5_live_breaker",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from webcorpus.plans import catalog
    from webcorpus.session import build_session

    spark = build_session(
        f"local[{cpus}]", "webcorpus-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = catalog.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    # pages that the crawl itself visited
    crawled = queries["f12_crawl_summary"](spark, sf_dir).first()["total"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus, "pages_per_sec": {"parse_dedup_report": round(pages / times["flagship_host_report"], 1), "markdown": round(pages / times["d18_markdown"], 1), "crawl": round(crawled / times["f5_crawl"], 1)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
