import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webcorpus.functions import text as X
from webcorpus.operators import evidence as V, memory as M


def test_relevance(col):
    rows = [("the quick brown fox", "quick fox"), ("nothing here", "quick fox"), ("a quick fox ran", "quick fox"), ("x" * 6000, "zzz"), ("abc", "")]
    got = [round(x, 6) for x in col(lambda c, q: X.relevance(F.col(c), F.col(q)), rows, "c", "q")]
    assert got == [round(1 + 0, 6), round(len("nothing here") / 50000, 6), 1.0, 0.1, 0.5]
    assert col(lambda c, q: X.word_overlap(F.col(c), F.col(q)), [("a b", "a c"), ("", "a"), ("a", "")], "c", "q") == [0.5, 0.0, 0.0]


def test_quote(col):
    text = "Short. This sentence has nothing of interest in it. Spark joins are planned by the optimizer! Spark joins can be broadcast by the optimizer"
    q = lambda c, w: X.relevant_quote(F.col(c), F.col(w))
    assert col(q, [(text, "spark joins optimizer"), ("tiny", "x"), ("", "x")], "c", "w") == ["Spark joins are planned by the optimizer", "tiny", ""]


def test_first_paragraph(col):
    line = "This line is clearly longer than fifty characters, is it not?"
    assert col(X.first_paragraph, [f"# T\n\n{line}\nmore", "short", ""]) == [line, "short", ""]


def plain_chunks(text, size, overlap):
    """The chunking rule in words: windows, each cut after its best boundary past the middle."""
    out, begin, back = [], 0, min(overlap, size // 2)
    while begin < len(text):
        end = min(begin + size, len(text))
        if end < len(text):
            window = text[begin:end]
            for mark in ("\n\n", ". ", "\n"):
                cut = window.rfind(mark)
                if cut > size // 2:
                    end = begin + cut + len(mark)
                    break
        piece = text[begin:end].strip()
        out += [piece] if piece else []
        begin, finished = end - back, end == len(text)
        if begin <= 0 or begin >= end or finished:
            break
    rest = text[begin:].strip() if 0 < begin < len(text) else ""
    return out + ([rest] if rest and (not out or rest != out[-1]) else [])


@pytest.mark.parametrize("text, size, overlap", [
    ("Hello world", 100, 100), ("A" * 2000, 500, 50), ("", 100, 10), ("Sentence one. Sentence two. Sentence three.", 20, 100), ("para\n\n" * 300, 200, 30), ("line\n" * 100 + "x" * 900, 150, 0), ("  \n" * 50, 20, 5),
])
def test_chunks(spark, text, size, overlap):
    assert M.chunk_spans(text, size, overlap) == plain_chunks(text, size, overlap)
    df = spark.createDataFrame([(1, text)], "d long, t string")
    rows = M.chunks(df, "d", "t", size, overlap).orderBy("chunk_index").collect()
    assert [r.chunk for r in rows] == plain_chunks(text, size, overlap) and all(r.total_chunks == len(rows) for r in rows)


def test_random_chunks():
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bb ", ". ", "\n", "\n\n", "ccc"]) for _ in range(rnd.randrange(200)))
        size, overlap = rnd.randrange(4, 80), rnd.randrange(0, 40)
        assert M.chunk_spans(text, size, overlap) == plain_chunks(text, size, overlap)


def test_drop_tail(spark):
    df = spark.createDataFrame([(1, "A" * 2000)], "d long, t string")
    with_tail, without = M.chunks(df, "d", "t", 500, 50).count(), M.chunks(df, "d", "t", 500, 50, drop_tail=True).count()
    assert with_tail == without + 1


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    items, queries = rng.normal(size=(300, 8)), rng.normal(size=(23, 8))
    it = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "id long, embedding array<double>").repartition(7)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q long, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(queries) @ unit(items).T
    for batch in (5, 23, 4096):  # several query batches, an exact fit, one batch
        got = {(r.q, r["rank"]): (r.id, round(r.relevance, 9)) for r in M.nearest(it, qs, "id", "q", n=6, batch_queries=batch).collect()}
        want = {(q, k + 1): (int(i), round(max(0.0, float(sims[q, i])), 9)) for q in range(23) for k, i in enumerate(np.argsort(-sims[q])[:6])}
        assert got == want
    assert all(r.relevance >= 0.6 for r in M.nearest(it, qs, "id", "q", n=6, min_relevance=0.6, where=F.col("id") > 10).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_cells(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    asked = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = e.collect()
    m = np.array([r.embedding for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    want = {int(q): {int(x) for x in ids[np.lexsort((ids, -(m @ v)))[:10]]} for q, v in zip(ids, m) if q % 10 == 0}
    got = {}
    for r in M.nearest_by_cells(e, asked, "vec_id", "query_id", n=10, block=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert sum(len(want[q] & got[q]) for q in want) >= 0.9 * sum(len(want[q]) for q in want)


def test_cells_on_odd_rows(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "b", None), (4, "b", [0.6, 0.8]), (5, "a", [1.0, 0.0]), (5, "a", [1.0, 0.0])]
    items = spark.createDataFrame(rows, "id long, kind string, embedding array<double>")
    asked = spark.createDataFrame([(7, "a", [2.0, 0.0]), (8, "b", [2.0, 0.0]), (9, "c", [1.0, 1.0]), (10, "a", None)], "q long, kind string, embedding array<double>")
    got = M.nearest_by_cells(items, asked, "id", "q", n=2, match=("kind",)).collect()
    assert sorted((r.q, r.rank, r.id, round(r.relevance, 6)) for r in got) == [(7, 1, 1, 1.0), (7, 2, 5, 1.0), (8, 1, 4, 0.6)]
    assert M.nearest_by_cells(items, asked, "id", "q", min_relevance=0.9, match=("kind",)).filter("q = 8").count() == 0
    assert M.nearest_by_cells(items.limit(0), asked, "id", "q").count() == 0


def test_unanswered_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(rnd.randrange(1, n)))
    qs = [(rnd.choice("xyz"), text(12).upper() if rnd.random() < 0.5 else text(4), i) for i in range(120)]
    fs = [(rnd.choice("xyw"), text(14) if rnd.random() < 0.7 else text(3)) for _ in range(60)]
    got = V.unanswered(spark.createDataFrame(qs, "report_id string, question string, seq int"), spark.createDataFrame(fs, "report_id string, claim string"), first=None)
    want = {s for r, q, s in qs if not any(r == r2 and (q.lower() in c.lower() or c.lower() in q.lower()) for r2, c in fs)}
    assert {r.seq for r in got.collect()} == want and want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_report_body(spark):
    rep = spark.createDataFrame([("r", "Spark"), ("e", "None")], "report_id string, query string")
    f = spark.createDataFrame([("r", 1, "joins", "Joins are fast", 0.9, ["a.org", "b.org", "c.org"]), ("r", 2, "big data", "Maybe slow", 0.3, []), ("r", 3, "joins", "Sorts help", 0.95, [])],
                              "report_id string, seq int, topic string, claim string, confidence double, domains array<string>")
    c = spark.createDataFrame([("r", 1, "T", "http://a", "a.org", "q" * 300)], "report_id string, seq int, title string, url string, domain string, quote string")
    body = {r.report_id: r.body for r in V.report_bodies(rep, f, c, F.lit("2024-01-30 10:20:00").cast("timestamp")).collect()}
    want = (
        "# Research Report: Spark\n\n*Generated: 2024-01-30 10:20 UTC*\n## Executive Summary\nThis research examined 'Spark' across 1 sources and identified 3 distinct findings. "
        "2 findings are supported by high-confidence evidence.\n\n## Findings by Topic\n### Joins\n**[HIGH CONFIDENCE]** Sorts help\n**[HIGH CONFIDENCE]** Joins are fast\n  *Sources: a.org, b.org*\n\n"
        "### Big Data\n**[UNVERIFIED]** Maybe slow\n\n## Sources\n- [T](http://a) (a.org)\n  > \"" + "q" * 200 + "...\"\n\n## Areas Requiring Verification\n- **Maybe slow** (confidence: 30%)\n")
    assert body["r"] == want
    assert "identified 0 distinct findings" in body["e"]


def test_long_report_is_cut_to_its_words(spark):
    rep = spark.createDataFrame([("r", "Spark")], "report_id string, query string")
    f = spark.range(4000).select(F.lit("r").alias("report_id"), F.col("id").alias("seq"), (F.col("id") % 7).cast("string").alias("topic"), F.concat(F.lit("claim number "), "id").alias("claim"), (F.col("id") % 10 / 10).alias("confidence"))
    c = spark.createDataFrame([], "report_id string, seq int, title string, url string, domain string, quote string")
    r = V.report_bodies(rep, f, c, F.lit("2024-01-30").cast("timestamp"), "brief").first()
    assert len(r.body.split()) == 500 and r.words > 4000 * 3


def test_report_confidence(spark):
    s = spark.createDataFrame([("a", 1.0)] * 3 + [("a", 0.0)] * 3 + [("b", 0.5)] * 20, "report_id string, relevance double")
    c = spark.createDataFrame([("a",)] * 9, "report_id string")
    got = {r.report_id: round(r.confidence, 6) for r in V.report_confidence(s, c).collect()}
    assert got == {"a": round(0.24 + 0.18 + 0.3 - 0.3, 6), "b": round(0.4 + 0.15 + 0.3, 6)}


def test_memory_items_and_reports(spark):
    at = F.lit("2024-01-30").cast("timestamp")
    f = spark.createDataFrame([("r1", "c" * 3000, "t", 0.7, ["u"] * 9), ("r2", "", "t", None, [])], "report_id string, claim string, topic string, confidence double, source_urls array<string>")
    s = spark.createDataFrame([("r1", "query", "sum", 1, 0, 0.5)], "report_id string, query string, summary string, findings int, citations int, confidence double")
    items = M.store(None, M.finding_items(f, at), M.summary_items(s, at))
    rows = {r.type: r for r in items.collect()}
    assert len(rows["finding"].text) == 2000 and rows["finding"].sources.count("u") == 5 and rows["report_summary"].text.startswith("Research: query\n\nSummary: sum")
    assert M.count(M.store(items, M.finding_items(f, at))).first().items == 2
    assert [r.report_id for r in M.reports(items).collect()] == ["r1"]
    assert M.delete_report(items, spark.createDataFrame([("r1",)], "report_id string")).isEmpty()


@pytest.mark.parametrize("match", [(), ("kind",)])
def test_all_cells_visit_every_block_once(spark, match):
    """All cells probed: the exact answer, with a copy of a query for each block and not for each cell."""
    rnd = random.Random(7)
    rows = [(i, "abc"[i % 3], [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(i, "a", [1.0, 2.0, 3.0, 4.0]) for i in range(300, 400)] + [(400, None, [1.0] * 4), (401, "a", None)]
    items = spark.createDataFrame(rows, "id long, kind string, embedding array<float>")
    asked = items.select(F.col("id").alias("q"), "kind", "embedding")
    m = {i: np.array(v, dtype=np.float32).astype(float) for i, _, v in rows if v}
    m = {i: v / np.linalg.norm(v) for i, v in m.items()}
    kind = {i: k for i, k, _ in rows}
    for block in (20, 1000):
        got = {}
        for r in M.nearest_by_cells(items, asked, "id", "q", n=3, probes=1 << 20, match=match, wide_block=block).collect():
            got.setdefault(r.q, {})[r.rank] = (r.id, r.relevance)
        for q in (0, 1, 2, 150, 399):
            near = sorted((-round(float(m[q] @ v), 9), i) for i, v in m.items() if not match or kind[i] == kind[q] and kind[i])[:3]
            assert [round(got[q][k][1], 6) for k in (1, 2, 3)] == [round(max(0.0, -s), 6) for s, _ in near]
            if q < 300:
                assert got[q][1][0] == q
        assert len(got) == (400 if match else 401) and 401 not in got


def test_best_places():
    sims = np.array([[0.5, 0.9, 0.9, 0.1], [0.2, 0.2, 0.2, 0.2], [np.nan, 0.1, np.nan, 0.3]])
    assert M._best(sims, 2).tolist() == [[1, 2], [0, 1], [3, 1]] and M._best(sims, 4)[2].tolist() == [3, 1, 0, 2]


def test_chunks_of_many_rows_come_in_pieces(spark):
    """Rows of an Arrow batch become Python values a few at a time."""
    from webcorpus.operators.batches import pieces
    import pyarrow as pa

    wide = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 20_000] * 999 + ["y" * 5_000_000])], names=["i", "t"])
    cut = list(pieces([wide, wide.slice(0, 0)]))
    assert [i for names, _ in cut for i in names.to_pylist()] == list(range(1000))
    assert max(len(names) * 20_000 for names, _ in cut[:-1]) <= 1 << 21 and len(cut) > 8
    docs = spark.createDataFrame([(i, "A sentence. " * (i % 300)) for i in range(700)] + [(None, "short one"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_index): (r.total_chunks, r.chunk) for r in M.chunks(docs, "doc_id", "text").collect()}
    for i in (1, 299, 699):
        want = M.chunk_spans("A sentence. " * (i % 300), 1000, 100)
        assert [got[i, k] for k in range(len(want))] == [(len(want), c) for c in want]
    assert got[None, 0] == (1, "short one")
