import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webcorpus.operators import health as Hh
from webcorpus.sources import readers, sinks
from webcorpus.streaming import jobs as S

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def feed(spark, tmp_path):
    """Write batches as files with rising times and stream them one file at a time."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))

    return make


def at(s):
    return T0 + timedelta(seconds=s)


def test_breaker_state_survives_between_batches(spark, feed):
    schema = "host string, call_id long, start_ts timestamp, ts timestamp, ok boolean"
    rows = [("h", i, at(i * 5), at(i * 5 + 1), i % 7 > 4) for i in range(40)]
    live = S.run_to_table(S.breaker(feed([rows[:10], rows[10:25], rows[25:]], schema), 2, 10.0), "t-breaker")
    batch = Hh.replay_breaker(spark.createDataFrame(rows, schema), 2, 10.0)
    cols = ["call_id", "kind", "admitted", "state", "run"]
    assert sorted(map(tuple, live.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_multiplier_state_survives_between_batches(spark, feed):
    schema = "host string, id long, ts timestamp, ok boolean"
    rows = [("h", i, at(i), i % 3 > 0) for i in range(30)]
    live = S.run_to_table(S.rate_multipliers(feed([rows[:7], rows[7:]], schema)), "t-rate")
    final = live.orderBy(F.col("ts").desc()).first().multiplier
    assert abs(final - Hh.rate_multiplier(spark.createDataFrame(rows, schema)).first().multiplier) < 1e-9


def test_watch_counts_across_batches(feed):
    rows = [("u", at(i), f"text version {i // 3}") for i in range(9)]
    out = S.run_to_table(S.watch_changes(feed([rows[:4], rows[4:]], "url string, ts timestamp, text string")), "t-watch").orderBy("ts").collect()
    assert [r.change_count for r in out] == [0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_dedup_stream_across_batches(feed):
    rows = [("Same  text", at(0)), ("other", at(1)), ("same text", at(2))]
    assert S.run_to_table(S.dedup_stream(feed([rows[:2], rows[2:]], "text string, ts timestamp"), "text", "ts"), "t-dedup").count() == 2


def test_stream_dedup_over_any_distance(feed):
    rows = [(5, "A  b"), (3, "a B"), (9, "c"), (1, None), (12, "C"), (11, "d"), (2, "a b"), (13, "D"), (14, "e"), (15, ""), (16, None)]
    out = S.dedup_to_table(feed([rows[:4], rows[4:7], rows[7:]], "doc_id long, text string"), "text", "doc_id", "t-dedup-all")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 9, 11, 14, 15]


def test_last_windows_come_out(feed):
    rows = [("h", at(0), True), ("h", at(10), False), ("g", at(31), False), ("h", at(200), False)]
    out = S.run_to_keyed_table(S.failure_rates(feed([rows[:1], rows[1:3], rows[3:]], "host string, ts timestamp, ok boolean")), "t-rates", ["start", "host"]).collect()
    got = {(r.host, int((r.start - at(0)).total_seconds())): (r.calls, r.failures) for r in out}
    want = {("h", s): (2, 1) for s in (0, -30, -60, -90)} | {("g", s): (1, 1) for s in (30, 0, -30, -60)} | {("h", s): (1, 1) for s in (180, 150, 120, 90)}
    assert got == want


def test_expired_entries(feed):
    batches = [[("a", at(0), 10.0), ("b", at(1), 5000.0)], [("a", at(5), 10.0)], [("z", at(100), 1.0)], [("z", at(200), 1000.0)]]
    out = S.run_to_table(S.expirations(feed(batches, "key string, stored_at timestamp, ttl double")), "t-expire").collect()
    base = int(T0.timestamp()) if T0.tzinfo else int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert {(r.key, r.stored_us // 10**6 - base) for r in out} >= {("a", 5)} and all(r.key != "b" for r in out)
    assert ("a", 0) not in {(r.key, r.stored_us // 10**6 - base) for r in out}


def test_url_list_and_origin_files(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("http://a \n\n# note\n  http://b\n")
    assert [r.url for r in readers.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["http://a", "http://b"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "e.com.txt").write_text("User-agent: *\nDisallow: /x\nSITEMAP: https://e.com/s.xml\n")
    robots = readers.robots_files(spark, str(tmp_path / "r"))
    assert robots.first().host == "e.com"
    assert {r.sitemap for r in readers.sitemap_locations(robots).collect()} == {"https://e.com/sitemap.xml", "https://e.com/s.xml"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "e.com.xml").write_text("<urlset><url><loc>http://e.com/1</loc></url></urlset>")
    assert readers.sitemap_files(spark, str(tmp_path / "s")).first().xml.startswith("<urlset>")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "id int, s string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"))
    assert {r.s for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"a,b", "c"}
    with pytest.raises(ValueError, match="nested columns: l"):
        sinks.write_csv(df.withColumn("l", F.array("id")), str(tmp_path / "x"))
    rows = sinks.documents_and_summary(df, df.filter("id = 1")).collect()
    assert [r.event for r in rows] == ["document", "document", "done"] and json.loads(rows[-1].data) == {"completed": 2, "errors": 1}
    log = spark.createDataFrame([(1, "e" * 5000, None, at(0))], "id int, error string, response_summary string, created_at timestamp")
    sinks.append_log(log, str(tmp_path / "l"))
    sinks.append_log(log, str(tmp_path / "l"))
    back = spark.read.parquet(str(tmp_path / "l"))
    assert back.count() == 2 and len(back.first().error) == 4097
