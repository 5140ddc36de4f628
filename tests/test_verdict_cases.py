"""Cases that stored pages do not show: attributes inside other names, gaps in positions, fractional lifetimes, long strings."""

import datetime as dt

from webcorpus.functions import html as H
from webcorpus.operators import extraction as Ex, freshness as Fr


def test_attribute_names_are_whole(col):
    rows = ['<a data-href="/x" href="/y">z</a>', "<a title='t' HREF='/q'>z</a>", '<a data-href="/x">z</a>']
    assert col(H.hrefs, rows) == [["/y"], ["/q"], []]


def test_page_budget_with_gaps(spark):
    df = spark.createDataFrame([("j", 1, "u1", "t", "abc"), ("j", 9000, "u2", "t", "def")], "job_id string, position int, url string, title string, markdown string")
    assert [r.position for r in Ex.page_budget(df).orderBy("position").collect()] == [1, 9000]


def test_fractional_lifetimes(spark):
    at = lambda s: dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    stored = spark.createDataFrame([("a", at(0.95), 1.9), ("b", at(0.5), 0.4)], "key string, stored_at timestamp, ttl double")
    asked = spark.createDataFrame([("a", 1, at(2.3)), ("a", 2, at(2.9)), ("b", 3, at(0.85)), ("b", 4, at(1.2))], "key string, req_id int, req_ts timestamp")
    assert {r.req_id: r.hit for r in Fr.lookup(asked, stored).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_character_references(col):
    import html

    rows = ["caf&eacute; &#8217;", "&amp;lt; &amp;amp;", "a & b &", "&notit; &not &ampx", "&#x1F600;&#0;&#150;&#xD800;&#1;", "&unknown; &;&#;", "&NotEqualTilde;&CounterClockwiseContourIntegral;", "plain", "", "&#00065;&#x00041", "&#99999999;", None]
    assert col(H.unescape, rows) == [None if r is None else html.unescape(r).replace("\xa0", " ") for r in rows]
    assert col(H.unescape, ["a&nbsp;b&#160;c"]) == ["a b c"]


def test_main_content_nests(col):
    rows = ['<body><div role="main"><div>one</div><p>two</p></div><p>x</p></body>',
            "<article>a<article>b</article>c</article>d", "<body><main><p>open</body>z", "<article>a<article>b</article>c", "<div role='main' class=x>q</div>z", "<p>none</p>"]
    assert col(H.main_content, rows) == ['<div role="main"><div>one</div><p>two</p></div>', "<article>a<article>b</article>c</article>",
                                         "<body><main><p>open</body>", "<article>a<article>b</article>c", "<div role='main' class=x>q</div>", "<p>none</p>"]


def test_noise_nests(col):
    rows = ['<p>a</p><div class="sidebar"><div>n1</div>noise2</div><p>b</p>', "a<div class='x sidebar'>n</div>b", '<div class="content">k<div class="ad">n</div>l</div>',
            '<span data-class="ad">k</span>', 'a<img class="ad" src=x>b', 'a<div class="ad">open', "<DIV CLASS=ads>n</DIV>k", None]
    assert col(H.without_noise_classes, rows) == ["<p>a</p><p>b</p>", "ab", '<div class="content">kl</div>', '<span data-class="ad">k</span>', "ab", 'a<div class="ad">open', "k", None]
    assert col(H.without_noise_tags, ["a<nav>1<nav>2</nav>3</nav>b<header>h</header>c", "<headers>k</headers>"]) == ["abc", "<headers>k</headers>"]
