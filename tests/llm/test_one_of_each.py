"""Null and repeated ids when one document of each group stays."""

from webcorpus.llm import set_join

A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


def kept(spark, rows):
    return sorted((tuple(r) for r in set_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_null_copy_of_a_row_with_an_id(spark):
    assert kept(spark, [(3, A), (None, A), (None, B), (None, None)]) == sorted([(3, A), (None, B), (None, None)], key=str)


def test_repeated_id_loses_only_the_copy(spark):
    assert kept(spark, [(3, B), (5, A), (5, B), (5, A)]) == [(3, B), (5, A)]


def test_near_copies_without_a_smallest_id(spark):
    got = kept(spark, [(None, A), (None, A + " more"), (7, B), (7, B + " more"), (None, C)])
    assert len(got) == 3 and (None, C) in got and {t.removesuffix(" more") for _, t in got} == {A, B, C}
