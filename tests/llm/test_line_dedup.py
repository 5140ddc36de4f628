"""Line removal against a plain version, on odd rows and in several batches."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from webcorpus.llm import line_dedup

SCHEMA = "doc_id long, text string, pos int, h1 long, gone string, batch int"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def odd_rows():
    rng = random.Random(5)
    common = [f"Common line number {i} ÄÖÜ" for i in range(12)] + ["short", "", "  \t", "exactly10!", "Exactly10! \r"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own line {i} {j} of many" for j in range(rng.randrange(9)))) for i in range(60)]
    rows += [(7, "Common line number 1 ÄÖÜ\nin a second row of seven"), (7, "Common line number 1 ÄÖÜ\nin a second row of seven"), (200, None), (201, ""), (202, "\n"), (203, "\n".join(f"line {i % 700} of a very long text" for i in range(5000)))]
    return rows + [(None, "a line without an id\nCommon line number 2 ÄÖÜ"), (None, "a line without an id"), (204, "A LINE WITHOUT AN ID\nune ligne É"), (205, "une ligne É\nUNE LIGNE é\nune ligne é")]


def plain(rows):
    key = lambda line: line.strip(line_dedup.BLANKS).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(float("inf") if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in holders or (float("inf") if i is None else i) == min(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return collections.Counter(out)


@pytest.mark.parametrize("batches,fan", [(1, 2), (5, 2), (4, 3)])
def test_line_dedup(spark, batches, fan):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], SCHEMA).repartition(3)
    got = line_dedup.dedup_lines(docs, batches, fan)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_one_frequent_line(spark):
    rows = [(i, f"the one line of all\nown text of {i}") for i in range(3000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter(tuple(r) for r in got.collect()) == plain(rows)


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect() == [(None, 1, 0, "")]


def test_runs_are_levelled_and_disjoint(spark):
    runs = line_dedup.LineRuns(spark, fan=2, buckets=4)
    for b in range(5):
        docs = spark.createDataFrame([(10 * b + i, f"line {i * b} of a batch\nshared by all of them") for i in range(6)], "doc_id long, text string")
        runs.add(line_dedup.line_hashes(docs))
    stored = [n for level in runs.levels for n in level]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    hashes = [tuple(r) for n in stored for r in runs._hashes(n).collect()]
    assert len(hashes) == len(set(hashes))
    plan = spark.table(stored[0]).groupBy("h1", "h2").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.drop()
    assert not runs.names
