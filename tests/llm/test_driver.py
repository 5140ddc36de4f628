"""What the training-data operators hold and plan in the driver."""

import tracemalloc

import numpy as np
from pyspark import Broadcast
from pyspark.sql import functions as F

from webcorpus.llm import common, set_join, toxicity


def test_rounds_read_stored_links(spark, monkeypatch):
    """The plan of the links is run once, not carried into the rounds; settled links take one round."""
    plans, store = [], common.cut_lineage

    def spy(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return store(df)

    monkeypatch.setattr(common, "cut_lineage", spy)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41), (None, 3), (7, 7)], "a long, b long").where("a <> 123456789")
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 21), 0), 41: 40}
    assert [p.count("123456789") for p in plans] == [1] + [0] * (len(plans) - 1)
    plans.clear()
    stars = spark.createDataFrame([(0, i) for i in range(1, 9)], "a long, b long")
    assert {r.node: r.component for r in common.components(stars).collect()} == dict.fromkeys(range(1, 9), 0)
    assert len(plans) == 2


def test_tables_of_shingles_are_given_back(spark, monkeypatch):
    gone, destroy = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (gone.append(1), destroy(self, *a)))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")
    sets = set_join.file_sets(docs, 5, 75)
    assert gone == [1] and sorted((r.doc_id, r.n) for r in sets.collect()) == [(1, 3), (2, 3), (3, 0)]


def test_fit_keeps_rows_packed(spark):
    """Features and votes take a byte a cell, and a Newton step holds few rows as floats."""
    rows = [([0, 2], 5, 1), ([], 0, None), ([1], 2, 0)]
    x, bits, truth = toxicity.fit_table(spark.createDataFrame(rows, "found array<int>, votes long, toxic int").repartition(1).toArrow(), 3, 3)
    got = sorted((x[i].tolist(), bits[i].tolist(), str(truth[i])) for i in range(3))
    assert got == sorted([([True, False, True], [1, 0, 1], "1.0"), ([False] * 3, [0] * 3, "nan"), ([False, True, False], [0, 1, 0], "0.0")])
    none = toxicity.fit_table(spark.createDataFrame([], "found array<int>, votes long, toxic int").toArrow(), 3, 2)
    assert [a.shape for a in none] == [(0, 3), (0, 2), (0,)]

    rng = np.random.default_rng(1)
    x = rng.random((8192, 400)) < 0.05
    p = (x[:, 0] | x[:, 1]).astype(float)
    tracemalloc.start()
    w, c = toxicity.fit_linear(x, p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 and w[0] > 1 and w[1] > 1 and np.abs(w[2:]).max() < 1 and c < 0
    whole = toxicity.fit_linear(x, p, block=8192)
    assert np.allclose(w, whole[0], atol=1e-9) and np.isclose(c, whole[1], atol=1e-9)


def test_frequencies_give_the_size_of_the_vocabulary(spark):
    from tokenizers import Tokenizer

    from webcorpus.llm import packing, tokens

    coded = packing.encode_documents(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    size = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json")).get_vocab_size()
    assert coded.agg(F.max(F.octet_length("frequencies"))).first()[0] == 4 * size


def test_facts_of_sources_start_no_python_worker(spark):
    """The few rows of a source's figures are a local relation, nulls and an empty table included."""
    from webcorpus.llm import mixing

    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", None), (3, None, "y")], "doc_id long, text string, source string")
    rows, _ = mixing.plan(mixing.with_sizes(docs))
    assert "LocalRelation" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.source, r.source_size) for r in rows.collect()) == [(1, "x", 3), (2, None, 2), (3, "y", 0)]
    assert mixing.plan(mixing.with_sizes(docs.limit(0)))[0].count() == 0
