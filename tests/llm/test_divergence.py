"""Source divergence against a plain version with Python's integers."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from webcorpus.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int"
ROWS = [
    (1, "The cat, the CAT; l'été Été don't", "en", "a"), (2, "cat\tdog the 12th 3x", "en", "a"), (3, "the cat dog the", "en", "b"), (4, "THE dog\0cat Été", "en", None), (5, None, "en", "c"),
    (6, "", "fr", "a"), (7, "un deux", "fr", "b"), (8, "ein Wort ein Wort", None, "a"), (9, "ein wort", None, None), (10, "ein Wort ÜBER über", None, "z"), (10, "ein Wort ÜBER über", None, "z"),
    (None, "dog été 中文 中文", "en", "é"), (11, "中文 dog " * 3000, "en", "a"), (12, "中文 été", "en", "Z"), (13, None, None, None), (14, "lone lone lone", "xx", "only"), (15, "lone", "xx", "only"), (16, "lone", "xx", "only"),
]


def plain(rows, least=3, top=200):
    docs = [(g or "", s or "", collections.Counter(TERM.findall((t or "").translate(LOWER)))) for _, t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for _, _, c in mine for t in c)
        kept = [t for t in seen if seen[t] >= least]
        count = {s: collections.Counter() for _, s, _ in mine}
        for _, s, c in mine:
            count[s].update(c)
        count[None] = sum((c for s, c in count.items()), collections.Counter())
        p = {}
        for s, c in count.items():
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        for s in count:
            if s is None:
                continue
            f = lambda o, ts: {t: (p[s][t] - p[o][t]) ** 2 // p[o][t] for t in ts}
            pairs = {o: sum(f(o, kept).values()) for o in count if o not in (s, None)}
            words = f(None, [t for t in kept if count[s][t] and p[s][t] > p[None][t]])
            for part, found in (("pair", pairs), ("term", words)):
                ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


@pytest.mark.parametrize("block,shards", [(400_000, None), (3, 5), (1, 1)])
def test_divergence(spark, block, shards):
    docs = spark.createDataFrame([(i, t, g, s, "x", 1) for i, t, g, s in ROWS], SCHEMA).repartition(3)
    got = divergence.divergence(docs, block=block, shards=shards)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(ROWS)


def test_top_and_least(spark):
    rows = [(i, " ".join(f"w{'abcdefghij'[(i * j) % 10]} v{'abcdefghij'[i % 7]}" for j in range(1, 9)), "en", f"s{i % 4}") for i in range(40)]
    got = divergence.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least_docs=5, top=2)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, 2)


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_64_bits():
    n = np.array([5, 10**13, 2 * 10**11], np.int64)
    total = np.array([10**13 + 7, 10**14, 3 * 10**11], np.int64)
    assert divergence.share(n, total).tolist() == [1 + 10**9 * (int(a) + 1) // int(b) for a, b in zip(n, total)]


def test_long_texts_are_cut_between_terms():
    text = "Über den Wolken " * 500 + "x" * 300
    assert [w for part in divergence.words(text, 64) for w in part] == [w.encode() for w in TERM.findall(text.translate(LOWER))]


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 15])
def test_merge_of_runs(size):
    rng = np.random.default_rng(size)
    entries = []
    for k in range(6):
        rows = [(b"k%02d" % rng.integers(30), [None, b"s", b"t"][rng.integers(3)], int(rng.integers(1, 9))) for _ in range(40 * min(k, 1))]
        entries.append(sorted(rows, key=lambda r: r[0]))
    want = collections.Counter()
    for rows in entries:
        for key, source, n in rows:
            want[key, source] += n
    tables = [pa.table([list(c) for c in zip(*rows)] if rows else [[], [], []], schema=divergence.RUN) for rows in entries]
    merged = list(divergence.merge_runs([divergence.pack_run(t, size) for t in tables]))
    got = [tuple(r.values()) for t in merged for r in t.to_pylist()]
    assert [r[0] for r in got] == sorted(r[0] for r in got) and {r[:2]: r[2] for r in got} == want and len(got) == len(want)
    assert all(a["key"][-1].as_py() < b["key"][0].as_py() for a, b in zip(merged, merged[1:]) if len(a) and len(b))


def test_corrections_handed_on_early():
    sums, got = divergence.Corrections(most=3), collections.Counter()
    for k in range(5):
        for b in [*sums.add("x", False, np.array([k % 2, 1]), np.array([[1, 2], [3, 4]])), *(sums.flush() if k == 4 else ())]:
            for r in b.to_pylist():
                got[r["i"], r["j"]] += r["value"]
    assert got == {(0, 0): 3, (0, 1): 6, (1, 0): 17, (1, 1): 24}
