"""Ordered per-key work without ever holding one key in one task.

A key (host, URL) may own a third of all rows, so a plain ``Window.partitionBy(key)`` would
put that third into one task. Rows are cut into *segments* of the order column (one hour of
time, a thousand versions, ...). Windows run inside (key, segment); one summary row per
segment is scanned per key and carried back. A segment is bounded by its width, a scan by
the number of segments a key has.
"""

from __future__ import annotations

import itertools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import cut_lineage

SEG = "_seg"
HOUR = 3600


def _order_number(df: DataFrame, order: str) -> Column:
    """Order column as a number: microseconds for timestamps, the value itself else."""
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order)


def with_segment(df: DataFrame, order: str, width: int) -> DataFrame:
    """Add the segment number; ``width`` is in seconds for timestamps."""
    unit = width * 1_000_000 if isinstance(
        df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)
    ) else width
    return df.withColumn(SEG, F.floor(_order_number(df, order) / F.lit(unit)).cast("long"))


def running(
    df: DataFrame, keys: list[str], order: str, width: int, ties: list[str] | None = None,
    sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and maxima per key in order, the current row included."""
    sums, maxes = sums or {}, maxes or {}
    seg = with_segment(df, order, width)
    for n, c in {**sums, **maxes}.items():
        seg = seg.withColumn(f"_v_{n}", c)
    part = [*keys, SEG]
    inside = W.partitionBy(*part).orderBy(order, *(ties or [])).rowsBetween(W.unboundedPreceding, 0)
    out = seg
    for n in sums:
        out = out.withColumn(n, F.sum(f"_v_{n}").over(inside))
    for n in maxes:
        out = out.withColumn(n, F.max(f"_v_{n}").over(inside))
    totals = seg.groupBy(*part).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes],
    )
    over = W.partitionBy(*keys).orderBy(SEG).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *part,
        *[F.sum(f"_t_{n}").over(over).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(over).alias(f"_c_{n}") for n in maxes],
    )
    out = out.join(carry, part)
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    for n in maxes:
        out = out.withColumn(n, F.greatest(F.col(n), F.col(f"_c_{n}")))
    return out.drop(SEG, *[f"_v_{n}" for n in [*sums, *maxes]], *[f"_c_{n}" for n in [*sums, *maxes]])


def previous(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, Column], width: int,
    ties: list[str] | None = None,
) -> DataFrame:
    """Values of the preceding row per key (``lag``), NULL on the first row of a key."""
    seg = with_segment(df, order, width)
    part = [*keys, SEG]
    rank = F.struct(order, *(ties or []))
    inside = W.partitionBy(*part).orderBy(order, *(ties or []))
    out = seg
    for n, c in cols.items():
        out = out.withColumn(f"_p_{n}", F.lag(c).over(inside))
    out = out.withColumn("_n", F.row_number().over(inside))
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    lasts = seg.groupBy(*part).agg(F.max_by(row, rank).alias("_last"))
    carry = lasts.select(*part, F.lag("_last").over(W.partitionBy(*keys).orderBy(SEG)).alias("_c"))
    out = out.join(carry, part)
    for n in cols:
        out = out.withColumn(n, F.when(F.col("_n") == 1, F.col("_c").getField(n)).otherwise(F.col(f"_p_{n}")))
    return out.drop(SEG, "_n", "_c", *[f"_p_{n}" for n in cols])


#: Bits of a row number below the number of its range.
_RANGE_BITS = 33


def numbered(df: DataFrame, sort: list[str | Column]) -> DataFrame:
    """Adds ``_id``, rising in the order of ``sort`` over the whole table: number of the range, then row in the range.

    Rows are dealt out by ranges of the full order, so a key with a third of all rows has a third of the ranges. The table is
    stored once, which fixes the numbers.
    """
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return cut_lineage(dealt.withColumn("_id", F.monotonically_increasing_id()))


def ranked(df: DataFrame, sort: list[str | Column]) -> DataFrame:
    """Adds ``_place``: how many rows come before, in the order of the whole table. One count a range goes to the driver."""
    rows = numbered(df, sort).withColumn("_range", F.shiftright("_id", _RANGE_BITS))
    counts = sorted(rows.groupBy("_range").count().collect())
    starts = list(zip([r for r, _ in counts], itertools.accumulate([0, *(n for _, n in counts)])))
    first = df.sparkSession.createDataFrame(starts, "_range long, _start long")
    inside = F.col("_id").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
    return rows.join(F.broadcast(first), "_range").withColumn("_place", F.col("_start") + inside).drop("_range", "_id", "_start")


def last_seen(df: DataFrame, keys: list[str], sort: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value that is not null, of the rows of a key up to and with this one.

    Windows run inside a range of the order (keys, sort); a key that spans ranges brings one row a range along.
    """
    rows = numbered(df.withColumn("_v", value), [*keys, *sort]).withColumn("_range", F.shiftright("_id", _RANGE_BITS))
    part = [*keys, "_range"]
    ends = rows.groupBy(*part).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_id"))).alias("_end"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    brought = ends.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(part)], F.last("_end", True).over(before).alias("_brought"))
    inside = W.partitionBy(*part).orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(part)]
    met = rows.withColumn("_in", F.last("_v", True).over(inside)).join(brought, same)
    return met.select(*df.columns, F.coalesce("_in", "_brought").alias(name))


def compose(df: DataFrame, key: str, sort: list[str], function: Column, join, tiers: tuple[int, ...] = (10, 20, _RANGE_BITS)) -> DataFrame:
    """``key, f``: the functions of a key's rows, composed in order. ``join(f, g)`` is g after f.

    ``function`` describes one row's map as a struct of fixed size. Pieces of at most 1024 consecutive rows become one
    function each, 1024 of these the next, then a whole range, then the key: every group is bounded, at any size of the key
    and by the same plan.
    """
    rows = numbered(df.select(key, *sort, function.alias("f")), [key, *sort]).select(key, "_id", "f")
    for bits in (*tiers, None):
        piece = [key] if bits is None else [key, F.shiftright("_id", bits).alias("_piece")]
        listed = rows.groupBy(*piece).agg(F.array_sort(F.collect_list(F.struct("_id", "f"))).alias("_r"))
        whole = F.aggregate(F.slice("_r", 2, F.size("_r")), F.col("_r")[0]["f"], lambda f, x: join(f, x["f"]))
        rows = listed.select(key, F.col("_r")[0]["_id"].alias("_id"), whole.alias("f"))
    return rows.select(key, "f")


def failures_in_a_row(df: DataFrame, keys: list[str], order: str, ok: str, ties: list[str] | None = None, name: str = "run_length") -> DataFrame:
    """Failures since the last success at every row.

    Inside a range the rows of a key are numbered without gaps, so a run is a difference of numbers; what a
    run brings along from earlier ranges is one row per key and range.
    """
    rows = numbered(df, [*keys, order, *(ties or [])]).withColumn("_range", F.shiftright("_id", _RANGE_BITS))
    good = F.when(F.col(ok), F.col("_id"))
    part = rows.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.max(good).alias("_good"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("_n").over(before), F.lit(0))
    part = part.withColumn("_passed", passed).withColumn("_at", F.when(F.col("_good").isNotNull(), F.col("_passed") + F.col("_good") - F.col("_first") + 1))
    part = part.withColumn("_carry", F.col("_passed") - F.coalesce(F.max("_at").over(before), F.lit(0)))
    inside = W.partitionBy(*keys, "_range").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    met = rows.withColumn("_last", F.max(good).over(inside)).join(part.select(*keys, "_range", "_first", "_carry"), [*keys, "_range"])
    run = F.coalesce(F.col("_id") - F.col("_last"), F.col("_id") - F.col("_first") + 1 + F.col("_carry"))
    return met.select(*df.columns, run.alias(name))


def halo(df: DataFrame, order: str, width: int) -> DataFrame:
    """Rows of each time segment plus a copy of the segment before it (``native`` false),
    so that a look-back of at most ``width`` never leaves its segment."""
    seg = with_segment(df, order, width)
    return seg.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *[c for c in seg.columns if c != SEG],
        (F.col(SEG) + F.col("_copy")).alias(SEG),
        (F.col("_copy") == 0).alias("native"),
    )


def exclusive_prefix(df: DataFrame, order: list[str], value: str, name: str, store=cut_lineage) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before this one, in the order of the whole table.

    Rows are dealt out by ranges of the order and stored, which fixes the ranges; a window runs inside each, and one sum a
    range (at most as many as shuffle partitions) is added up in between. No task sees more than its range.
    """
    dealt = store(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = sorted(dealt.groupBy("_part").agg(F.sum(value)).collect())
    starts = zip([p for p, _ in sums], itertools.accumulate([0, *(n or 0 for _, n in sums)]))
    first = df.sparkSession.createDataFrame(list(starts), "_part int, _first long")
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return dealt.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_first")


_WHOLE = 10**11  # wider than any history: one segment per key


def segment_width(df: DataFrame, keys: list[str], order: str, width: int = HOUR, target_rows: int = 500_000) -> int:
    """Width at which no segment of any key holds much more than ``target_rows`` rows.

    One narrow aggregate over key and order column. When even the largest key fits, every
    key is one segment; else the width shrinks with the fullest segment.
    """
    per_seg = with_segment(df.select(*keys, order), order, width).groupBy(*keys, SEG).count()
    per_key = per_seg.groupBy(*keys).agg(F.max("count").alias("m"), F.sum("count").alias("s"))
    fullest, largest = per_key.agg(F.max("m"), F.max("s")).first()
    if (largest or 0) <= target_rows:
        return _WHOLE
    return max(1, width // max(1, -(-fullest // target_rows)))


def fold(
    df: DataFrame, key: str, order: str, step, initial: dict, output: str, out_fields: dict,
    width: int = HOUR, ties: list[str] | None = None, target_rows: int = 500_000,
) -> DataFrame:
    """Sequential state machine per key over ordered rows, segment by segment.

    ``step(state, rows)`` takes a state dict and the ordered rows (list of dicts) of one
    segment and returns (new state, list of output dicts).

    Every segment first runs from the initial state. A segment whose predecessor ended in a
    state other than the one it started from runs again; the rounds stop when every segment
    started where its predecessor ended, which is the exact sequential result. Machines that
    forget (breakers, buckets) settle after two or three rounds, and a key with one segment
    needs none. The state table has one row per (key, segment); the segment width shrinks
    until no segment holds more than about ``target_rows`` rows.
    """
    width = segment_width(df, [key], order, width, target_rows)
    start_text = json.dumps(initial, sort_keys=True)
    in_cols, sort_cols = list(df.columns), [order, *(ties or [])]
    key_type = df.schema[key].dataType.simpleString()

    def groups(batches):
        """(key, segment, entry state, rows) of consecutive rows, cut at batch ends."""
        for pdf in batches:
            marks = list(zip(pdf[key], pdf[SEG]))
            values = list(zip(*(pdf[c].tolist() for c in in_cols)))
            entries = pdf["_entry"].tolist()
            begin = 0
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[begin]:
                    yield marks[begin], entries[begin], [dict(zip(in_cols, v)) for v in values[begin:i]]
                    begin = i

    def runs(batches):
        """(mark, entry, state, output) with the state carried over batch ends of a segment."""
        last, state = None, None
        for mark, entry, rows in groups(batches):
            state = json.loads(entry) if mark != last else state
            last = mark
            state, out = step(state, rows)
            yield mark, entry, state, out

    def end_states(batches):
        done = {}
        for mark, entry, state, _ in runs(batches):
            done[mark] = (*mark, entry, json.dumps(state, sort_keys=True))
            if len(done) > 5000:
                # all but the segment under way are complete
                current = done.pop(mark)
                yield pd.DataFrame(list(done.values()), columns=[key, SEG, "_entry", "_exit"])
                done = {mark: current}
        if done:
            yield pd.DataFrame(list(done.values()), columns=[key, SEG, "_entry", "_exit"])

    def emit(batches):
        held = []
        for _, _, _, out in runs(batches):
            held += out
            if len(held) > 5000:
                yield frame(held)
                held = []
        if held:
            yield frame(held)

    def frame(rows):
        return pd.DataFrame(rows, columns=list(out_fields)).astype({n: t for n, t in out_fields.items() if t})

    def scan(rows: DataFrame, fn, schema: str) -> DataFrame:
        """Rows of a segment together and in order; workers stream them batch by batch."""
        return rows.repartition(key, SEG).sortWithinPartitions(key, SEG, *sort_cols).mapInPandas(fn, schema)

    seg = with_segment(df, order, width)
    if width == _WHOLE:
        return scan(seg.withColumn("_entry", F.lit(start_text)), emit, output)
    seg = cut_lineage(seg)
    state_schema = f"`{key}` {key_type}, {SEG} long, _entry string, _exit string"
    states = cut_lineage(scan(seg.withColumn("_entry", F.lit(start_text)), end_states, state_schema))
    w = W.partitionBy(key).orderBy(SEG)
    while True:
        linked = states.withColumn("_want", F.coalesce(F.lag("_exit").over(w), F.lit(start_text)))
        stale = linked.filter(F.col("_want") != F.col("_entry"))
        if stale.isEmpty():
            break
        redo = scan(seg.join(stale.select(key, SEG, F.col("_want").alias("_entry")), [key, SEG]), end_states, state_schema)
        kept = linked.filter(F.col("_want") == F.col("_entry")).select(key, SEG, "_entry", "_exit")
        states = cut_lineage(kept.unionByName(redo))
    return scan(seg.join(states.select(key, SEG, "_entry"), [key, SEG]), emit, output)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str | None = None,
          salts: int = 64) -> DataFrame:
    """First ``k`` rows per key.

    Spark limits each map task to ``k`` rows per key before the shuffle for k up to 1000
    (window group limit). Beyond that a salted first pass does the same.
    """
    rn = "_rn"
    if k > 1000:
        first = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
            .withColumn(rn, F.row_number().over(first)).filter(F.col(rn) <= k).drop(rn, "_salt")
        )
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out.withColumnRenamed(rn, name) if name else out.drop(rn)
