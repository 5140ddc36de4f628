import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from webcorpus.functions import text as X
from webcorpus.operators import changes as C, freshness as J, logs as L, segments as G, selectors as K

T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.mark.parametrize("a, b, same", [
    ("see http://a/1 now", "see https://b/2 now", True), ("at 10:30am ok", "at 11:45pm ok", True), ("on 12/05/2024", "on 01/06/2023", True),
    ("Hello World", "hello   world", True), ("a​b", "ab", True), ("Price is 10", "Price is 11", False), ("", "  ", True),
])
def test_change_hash(col, a, b, same):
    x, y = col(X.change_hash, [a, b])
    assert (x == y) == same and len(x) == 64


def test_content_hash(col):
    h = col(X.content_hash, ["Hello  World\n", "hello world", "other"])
    assert h[0] == h[1] != h[2] and len(h[0]) == 16


@pytest.mark.parametrize("old, new, added, removed", [
    ("This is the first sentence. This is the second one here.", "This is the first sentence. This is the second one here. A third sentence has been added now.", 1, 0),
    ("This is the first sentence. This is the second one here.", "This is the first sentence.", 0, 1), ("Same text in both versions.", "Same text in both versions.", 0, 0), ("Tiny one here.", "Tiny two here.", 0, 0),
])
def test_sentence_changes(col, old, new, added, removed):
    changes = col(lambda o, n: X.sentence_changes(F.col(o), F.col(n)), [(old, new)], "o", "n")[0]
    assert sum(c.startswith("+ Added: ") for c in changes) == added and sum(c.startswith("- Removed: ") for c in changes) == removed


@pytest.fixture()
def skewed(spark):
    """One key holds a third of the rows; segments of every size, also empty ones."""
    k = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 17).cast("string")))
    return spark.range(3000).select(
        "id", k.alias("key"), (F.col("id") * 7 + F.pmod(F.hash("id"), F.lit(50))).alias("t"), F.pmod(F.hash(F.col("id") + 1), F.lit(5)).alias("v"),
        F.when(F.pmod(F.hash("id"), F.lit(4)) > 0, F.lit(True)).otherwise(False).alias("ok"))


@pytest.mark.parametrize("width", [1, 37, 500, 10**9])
def test_segmented_windows_equal_plain_windows(skewed, width):
    w = W.partitionBy("key").orderBy("t", "id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    got = G.running(skewed, ["key"], "t", width, ["id"], sums={"s": F.col("v")}, maxes={"m": F.col("v")})
    want = skewed.withColumn("s", F.sum("v").over(run)).withColumn("m", F.max("v").over(run))
    cols = ["id", "s", "m"]
    assert got.select(cols).exceptAll(want.select(cols)).isEmpty() and got.count() == 3000
    prev = G.previous(skewed, ["key"], "t", {"p": F.col("v")}, width, ["id"])
    assert prev.select("id", "p").exceptAll(skewed.select("id", F.lag("v").over(w).alias("p"))).isEmpty()
    island = skewed.withColumn("i", F.sum(F.col("ok").cast("int")).over(run))
    runs = island.select("id", F.when(F.col("ok"), 0).otherwise(F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("key", "i").orderBy("t", "id"))).cast("long").alias("run_length"))
    assert G.failures_in_a_row(skewed, ["key"], "t", "ok", ["id"]).select("id", "run_length").exceptAll(runs).isEmpty()


def test_salted_top_k(skewed):
    got = G.top_k(skewed, ["key"], [F.col("v").desc(), F.col("id")], 1001)
    want = skewed.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.col("v").desc(), "id"))).filter("r <= 1001").drop("r")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_watch_history(spark):
    rows = [("u", at(i), f"Version {i // 2} of the page has this text.") for i in range(7)] + [("v", at(0), "only")]
    tracked = C.track(spark.createDataFrame(rows, "url string, ts timestamp, text string"), keep_text=True, width=2)
    st = {r.url: r for r in C.watch_status(tracked, keep=3).collect()}
    assert (st["u"].snapshot_count, st["u"].change_count, st["u"].last_change) == (3, 3, at(6))
    assert (st["v"].change_count, st["v"].last_change) == (0, None)
    assert len(C.history(tracked, n=3).filter("url = 'u'").first().history) == 3
    events = C.change_events(C.sentence_diffs(tracked), width=2).orderBy("detected_at").collect()
    assert [(e.url, e.change_count, e.change_count_this_watch) for e in events] == [("u", 1, 2), ("u", 2, 2), ("u", 3, 2)]
    diff = C.unified_diffs(tracked).filter("changed").first().diff
    assert diff.startswith("--- \n+++ \n@@ -1 +1 @@\n-Version")


def test_watch_registry(spark):
    s = "url string, webhook_url string, selectors array<string>"
    cur = spark.createDataFrame([("http://a/x", "old", ["p"], False), ("http://b", "b", ["q"], False)], s + ", enabled boolean")
    new = spark.createDataFrame([("http://a/x", "", []), ("http://c", "c", ["r"])], s)
    got = {r.url: (r.domain, r.webhook_url, r.selectors, r.enabled) for r in C.register_watches(cur, new).collect()}
    assert got == {"http://a/x": ("a", "old", ["p"], True), "http://b": ("b", "b", ["q"], False), "http://c": ("c", "c", ["r"], True)}


def test_lookup_uses_only_the_latest_entry(spark):
    stored = spark.createDataFrame([("k", at(0), 1000.0), ("k", at(100), 10.0), ("j", at(5), 50.0)], "key string, stored_at timestamp, ttl double")
    req = [("k", 1, at(50), True), ("k", 2, at(110), True), ("k", 3, at(111), False), ("k", 4, at(-1), False), ("j", 5, at(55), True), ("j", 6, at(56), False), ("z", 7, at(9), False)]
    got = {r.req_id: r.hit for r in J.lookup(spark.createDataFrame([r[:3] for r in req], "key string, req_id int, req_ts timestamp"), stored).collect()}
    assert got == {r[1]: r[3] for r in req}


def test_lookup_spreads_one_key_and_one_long_life(spark):
    rng = random.Random(5)
    stored = [(rng.choice("aaab"), at(rng.randint(0, 5000)), rng.choice([1.0, 20.0, 400.0, 3e7, None])) for _ in range(300)]
    asked = [(rng.choice(["a", "a", "b", "c", None]), i, at(rng.randint(0, 6000)) if i % 50 else None) for i in range(900)] + [("a", 7, at(9))] * 2
    best = {}
    for k, s, ttl in stored:
        best[k, s] = max(best.get((k, s), -1), -1 if ttl is None else ttl)

    def hit(k, t):
        past = [s for key, s in best if key == k and t is not None and s <= t]
        return bool(past) and best[k, max(past)] >= 0 and (t - max(past)).total_seconds() <= best[k, max(past)]

    s = spark.createDataFrame(stored, "key string, stored_at timestamp, ttl double")
    a = spark.createDataFrame(asked, "key string, req_id int, req_ts timestamp")
    got = J.lookup(a, s).collect()
    assert sorted((r.req_id, r.hit) for r in got) == sorted((i, hit(k, t)) for k, i, t in asked)
    assert J.lookup(a, s.limit(0)).filter("hit").isEmpty() and J.lookup(a.limit(0), s).isEmpty()


def test_last_seen_over_ranges(skewed):
    value = F.when(F.col("ok"), F.col("v"))
    over = W.partitionBy("key").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    want = skewed.select("id", F.last(value, True).over(over).alias("p"))
    got = G.last_seen(skewed, ["key"], ["t", "id"], value, "p").select("id", "p")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_cache_keys_of_options_do_not_collide(spark):
    f = F.array(F.lit("b"), F.lit("a"))
    r = spark.range(1).select(
        J.cache_key(F.lit(" HTTP://A "), f).alias("a"), J.cache_key(F.lit("http://a"), F.array(F.lit("a"), F.lit("b"))).alias("b"),
        J.cache_key(F.lit("http://a"), f, {"m": F.lit("true")}).alias("c"), J.cache_key(F.lit("http://a"), f, {"m": F.lit(None).cast("string")}).alias("d")).first()
    import hashlib, json
    want = hashlib.sha256(json.dumps({"url": "http://a", "formats": ["a", "b"]}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert r.a == r.b == r.d == want != r.c


def test_selectors(spark):
    rows = [("u", s, at(0)) for s in ["a", "a", " a ", "b", "b", "c", "  "]] + [("v", "x", at(90000))]
    m = K.uses(spark.createDataFrame(rows, "url string, selector string, ts timestamp"))
    now = F.lit(at(100)).cast("timestamp")
    assert [(r.selector, r.score) for r in K.suggestions(m.filter("url = 'u'"), now, 2).orderBy("rank").collect()] == [("a", 3.0), ("b", 2.0)]
    old = F.lit(at(200000)).cast("timestamp")
    assert K.hints(m, old).filter("url = 'u' AND selector = 'a'").first().score == 0.3
    assert {(r.url, r.selector) for r in K.capped(m, 1, 1).collect()} == {("v", "x")}
    gone = spark.createDataFrame([("v", None), ("u", "a")], "url string, selector string")
    assert {(r.url, r.selector) for r in K.forget(m, gone).collect()} == {("u", "b"), ("u", "c")}


def test_log_rows_and_pages(spark):
    log = spark.createDataFrame([(i, "u", "scrape" if i % 2 else "crawl", "success", "e" * (4096 + i), "", at(i)) for i in range(5)],
                                "id int, url string, method string, status string, error string, response_summary string, created_at timestamp")
    assert sorted(len(r.error) for r in L.log_rows(log).collect()) == [4096, 4097, 4097, 4097, 4097]
    assert [r.id for r in L.list_rows(log, 2, 1).collect()] == [3, 2]
    assert [r.id for r in L.list_rows(log, method="scrape").collect()] == [3, 1]
    assert {(r.kind, r.value): r.n for r in L.log_stats(log).collect()} == {("total", "all"): 5, ("status", "success"): 5, ("method", "scrape"): 2, ("method", "crawl"): 3}


def test_large_url_cap_is_no_top_k(spark):
    """A top-k reserves room for its cap in every task."""
    rows = [(f"u{i % 50}", f"s{i % 7}", at(i)) for i in range(500)] + [(None, "s", at(1))]
    m = K.uses(spark.createDataFrame(rows, "url string, selector string, ts timestamp"))
    got = K.capped(m, 3, 1_000_000_000)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.exceptAll(K.capped(m, 3, 10_000)).isEmpty() and got.count() == 150
    few = K.capped(m, 3, 20)
    K._TOP_K, before = 10, K._TOP_K
    try:
        assert K.capped(m, 3, 20).exceptAll(few).isEmpty() and few.count() == 60
    finally:
        K._TOP_K = before


def test_sentences_are_kept_in_place_of_texts(spark):
    rows = [("u", i, f"The first sentence stays as it is. Sentence number {i // 2} of the page is new!") for i in range(9)] + [("v", 1, None), ("v", 2, "One long sentence that was added here.")]
    snapshots = spark.createDataFrame(rows, "url string, ts long, text string")
    got = C.sentence_diffs(C.track(snapshots, width=2, keep_sentences=True))
    want = C.sentence_diffs(C.track(snapshots, width=2, keep_text=True))
    cols = ["url", "ts", "current_hash", "previous_hash", "changed", "changes"]
    assert "text" not in got.columns and got.select(cols).exceptAll(want.select(cols)).isEmpty() and got.count() == 11
    assert got.filter("changed").count() == 5


def test_marks_behind_a_search_for_bytes(col):
    texts = ["At 9:30PM  see https://x.org/a?b=1 on 12/05/2024", "a/b", "1\u200b\u20032\u200c 3", " \u2003x  y ", None]
    assert col(X.normalize_for_diff, texts) == ["at [TIME] see [URL] on [DATE]", "a/b", "1 2 3", "x y", ""]
