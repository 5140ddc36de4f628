"""Binding of inner results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once.

    Spark inlines a column wherever it is used; expressions that use an inner result many
    times would otherwise repeat its regular expressions and outgrow generated code.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def scan(values, zero: Column, step, piece: int = 64) -> Column:
    """Running states: element i is ``step(... step(zero, values[0]) ..., values[i])``.

    An array that grows by one is copied at every step, so states are gathered in pieces of ``piece``: the copying
    stays a few dozen references an element even where an array has a hundred thousand.
    """
    def grow(states, v):
        return F.concat(states, F.array(step(F.element_at(states, -1), v)))

    def run(values):
        def add(acc, k):
            return let(
                F.aggregate(F.slice(values, k * piece + 1, piece), F.array(acc["last"]), grow),
                lambda states: F.struct(F.element_at(states, -1).alias("last"), F.concat(acc["done"], F.array(F.slice(states, 2, piece))).alias("done")))

        none = F.slice(F.array(F.array(zero)), 1, 0)
        pieces = F.sequence(F.lit(0), F.ceil(F.size(values) / piece).cast("int") - 1)
        begun = F.aggregate(pieces, F.struct(zero.alias("last"), none.alias("done")), add)
        return F.when(F.size(values) > 0, F.flatten(begun["done"])).otherwise(F.slice(F.array(zero), 1, 0))

    return let(values, run)
