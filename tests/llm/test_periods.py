"""Runs of periodic words against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings, strategies as st

from webcorpus.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_text(words, runs):
    out = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in out)


def as_array(texts):
    numbers = {}
    flat = [numbers.setdefault((d, w), len(numbers)) for d, t in enumerate(texts) for w in t]
    return np.array(flat, np.int64), np.array([len(t) for t in texts], np.int64)


def found_runs(texts):
    words, lengths = as_array(texts)
    begins = np.cumsum(lengths) - lengths
    out = [[] for _ in texts]
    for s, e, q in zip(*(x.tolist() for x in periods.runs_of(words, lengths))):
        d = int(np.searchsorted(begins + lengths, s, side="right"))
        out[d].append((s - int(begins[d]), e - s, q))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.sampled_from("ab"), max_size=90),
    st.lists(st.sampled_from("abc"), max_size=60),
    st.builds(lambda p, k, c, t: (p * k)[c:] + t, st.lists(st.sampled_from("abcd"), min_size=1, max_size=20), st.integers(1, 9), st.integers(0, 5), st.lists(st.sampled_from("ab"), max_size=20)),
    st.builds(lambda p, r, k, q: ((p * r + q) * k), st.lists(st.sampled_from("ab"), min_size=1, max_size=4), st.integers(1, 12), st.integers(1, 5), st.lists(st.sampled_from("ab"), max_size=4)),
), max_size=4))
def test_runs_of_short_texts(texts):
    assert found_runs(texts) == [plain_runs(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 700, "ab" * 300 + "c" + "ab" * 300, "aab" * 60 + "aabaab" + "a" * 40, ("ab" * 20 + "c") * 12, "ababababa" * 2])
def test_runs_of_long_texts(text):
    assert found_runs([list(text)]) == [plain_runs(list(text))]


def test_words_of_fibonacci_and_doubled_letters():
    a, b, t = "a", "ab", "a"
    for _ in range(11):
        a, b = b, b + a
    for _ in range(8):
        t += t.translate(str.maketrans("ab", "ba"))
    assert found_runs([list(b), list(t)]) == [plain_runs(list(b)), plain_runs(list(t))]


def test_operator_on_odd_rows(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "x " * 12), (5, "x " * 12), (5, "y " * 11), (None, "Ä b\n" * 9), (6, " ".join(rng.choice("abc") for _ in range(400)))]
    rows += [(7, " ".join(f"w{i % 977}" for i in range(30_000))), (8, "a b c d " * 20)]
    docs = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], "doc_id long, text string, start int, runs string, length int").repartition(3)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.text) for r in periods.periodic_runs(docs).collect()), key=str)
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    want = [(i, r := [(0, 30_000, 977)] if i == 7 else plain_runs(w), plain_text(w, r)) for i, w in words]
    assert got == sorted(want, key=str)
    assert periods.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_plain_version(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if n > 6000:
            continue
        runs = plain_runs(w)
        s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        want[r.doc_id] = (len(runs), s, m, q, None if q is None else 1000 * m // q, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(plain_text(w, runs)))
    got = {r[0]: tuple(r)[1:] for r in queries.op13_periods(spark, SF).collect()}
    assert {k: got[k] for k in want} == want and any(v[0] for v in want.values())
