import random

import pytest
from pyspark.sql import functions as F

from webcorpus.functions import urls as U
from webcorpus.operators import dedup, graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def chain(n):
    return [(f"p{i}", f"p{i + 1}") for i in range(n - 1)]


def tree(branching, depth):
    out, level = [], ["r"]
    for _ in range(depth):
        nxt = [f"{p}.{i}" for p in level for i in range(branching)]
        out += [(p, f"{p}.{i}") for p in level for i in range(branching)]
        level = nxt
    return out


@pytest.mark.parametrize("pairs, start, depth, nodes", [
    (chain(10), "p0", 20, 10), (chain(10), "p0", 3, 4), (tree(2, 3), "r", 3, 15), (tree(3, 3), "r", 3, 40), ([("s", f"l{i}") for i in range(50)], "s", 2, 51), ([("a", "a"), ("a", "b"), ("b", "a")], "a", 5, 2),
])
def test_reach_sizes(spark, pairs, start, depth, nodes):
    assert graph.reach(edges(spark, pairs), start, depth).count() == nodes


def test_depth_is_shortest_path(spark):
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(150)]
    dist, todo = {"n0": 0}, ["n0"]
    for u in todo:
        for a, b in pairs:
            if a == u and b not in dist:
                dist[b] = dist[u] + 1
                todo.append(b)
    got = {r.url: r.depth for r in graph.reach(edges(spark, pairs), "n0", 4).collect()}
    assert got == {u: d for u, d in dist.items() if d <= 4}


def test_reach_limit_finishes_the_page_that_meets_it(spark):
    pairs = [("s", "a"), ("s", "b"), ("a", "c"), ("a", "d"), ("b", "e")]
    assert {r.url for r in graph.reach(edges(spark, pairs), "s", 3, limit=4).collect()} == {"s", "a", "b", "c", "d"}
    assert {r.url for r in graph.reach(edges(spark, pairs), "s", 3, limit=3).collect()} == {"s", "a", "b"}


def test_edges_scope(spark):
    page = spark.createDataFrame([("http://e.com/a", ["/b", "http://s.e.com/c", "http://x.com/", "mailto:q", "b", "#t"])], "url string, hs array<string>")
    inside = {r.target for r in graph.edges(page, F.col("hs")).collect()}
    assert inside == {"http://e.com/b", "http://s.e.com/c"}
    assert {r.target for r in graph.edges(page, F.col("hs"), include_subdomains=True).collect()} == inside | {"http://x.com/"}


def simulate(pages, links, start, max_depth, max_pages, blocked=()):
    """Level-synchronous crawl written as plain loops."""
    import hashlib
    from urllib.parse import urlparse

    out, errors, queued, hashes, level = [], [], {start}, set(), [start]
    for depth in range(max_depth + 1):
        level.sort(key=lambda u: (len(u), u))
        fresh = []
        for u in level:
            if len(out) >= max_pages:
                break
            if urlparse(u).path in blocked or u not in pages:
                errors.append(u)
                continue
            h = hashlib.sha256(" ".join(pages[u].split()).lower().encode()).hexdigest()
            if h not in hashes:
                hashes.add(h)
                out.append(u)
            for v in links.get(u, []):
                if v not in queued and depth + 1 <= max_depth:
                    fresh.append(v)
        seen = []
        for v in fresh:
            if v not in seen and len(queued) + len(seen) < 2 * max_pages:
                seen.append(v)
        queued |= set(seen)
        level = seen
        if len(out) >= max_pages or not level:
            break
    return out, errors, queued


@pytest.mark.parametrize("seed, cap", [(1, 1000), (2, 12), (3, 5), (4, 30)])
def test_crawl_against_plain_loops(spark, seed, cap):
    rnd = random.Random(seed)
    urls = ["http://e.com/"] + [f"http://e.com/{'x' * rnd.randrange(3)}{i}" for i in range(60)]
    pages = {u: f"text {rnd.randrange(40)}" for u in urls if rnd.random() > 0.05 or u == urls[0]}
    links = {u: [rnd.choice(urls) for _ in range(rnd.randrange(6))] for u in urls}
    links[urls[0]] = urls[1:8]
    blocked = {"/" + u.rsplit("/", 1)[1] for u in urls[10:13]}
    rules = spark.createDataFrame([("e.com", "disallow", b) for b in blocked], "host string, kind string, pattern string")
    # exact paths only: no blocked path is a prefix of another page's
    blocked_all = {p for p in ("/" + u.rsplit("/", 1)[1] for u in urls) if any(p.startswith(b) for b in blocked)}
    df = spark.createDataFrame([(u, t, None, None) for u, t in pages.items()], "url string, markdown string, status int, error string")
    ln = spark.createDataFrame([(u, i, v) for u, vs in links.items() for i, v in enumerate(vs)], "source string, pos int, target string")
    r = graph.crawl(df, ln, urls[0], max_depth=3, max_pages=cap, rules=rules)
    out, errors, queued = simulate(pages, links, urls[0], 3, cap, blocked_all)
    assert {x.url for x in r["pages"].collect()} == set(out)
    assert {x.url for x in r["errors"].collect()} == set(errors)
    assert {x.norm for x in r["queued"].collect()} == queued
    s = r["summary"].first()
    assert (s.completed, s.total, s.errors) == (len(out), len(queued), len(errors))


def test_keep_first_has_unique_hashes_under_skew(spark):
    text = F.when(F.col("id") % 3 == 0, "The  same PAGE").otherwise(F.concat(F.lit("page "), (F.col("id") % 400).cast("string")))
    docs = spark.range(3000).select("id", text.alias("text"))
    kept = dedup.keep_first(docs, "text", [F.col("id")], "id")
    assert kept.count() == docs.select(F.lower(F.regexp_replace("text", " +", " "))).distinct().count()
    assert kept.filter("text like 'The%'").first().id == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pagination(spark):
    links = [("s", f"http://e.com/list/page/{i}") for i in (1, 2, 3, 3)] + [("s", "http://e.com/other/page/9"), ("s", "http://e.com/about")]
    rows = U.detect_pagination(spark.createDataFrame(links, "site string, url string"), "url", "site").collect()
    assert {(r.base, r.page) for r in rows} == {("http://e.com/list/page", 1), ("http://e.com/list/page", 2), ("http://e.com/list/page", 3)}
