"""How far the sources of a language stand apart in their words, by single-pass in-memory indexing.

One pass counts words in memory; when a block is full, its postings are split by hash shard and spilled as term-sorted runs. One
task a shard merges its runs with a heap into the counts of every term per source. The second pass streams these: a pair of sources differs
by a constant wherever neither holds a term, so only terms that one of them holds bring corrections.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .common import batch, each_row
from .shingles import hash_spans

#: Fixed value: shares are counted in units of one of this many.
UNIT = 1_000_000_000
#: Bytes that are no part of a term become blanks, A-Z small letters. Every byte of a character beyond ASCII belongs to a term.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
RUN = pa.schema([("key", pa.binary()), ("source", pa.binary()), ("n", pa.int64())])
SPILL = pa.schema([("shard", pa.int64()), ("run", pa.binary())])
POSTINGS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def words(text: str, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """Terms of a text in order; long texts are cut between terms."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_TERMS), 0
    while at < len(data):
        end = data.find(b" ", at + piece)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Block:
    """Postings of some documents: term counts per (lang, source), document counts per lang.

    A run's key is the term, a zero byte (no term holds one) and the language; the row without a source counts documents.
    """

    def __init__(self):
        self.counts, self.held = defaultdict(Counter), defaultdict(Counter)

    def add(self, lang: str, source: str, text: str) -> int:
        """Counts a document; returns by how many postings the block has grown."""
        mine, docs = self.counts[lang, source], self.held[lang]
        before, seen = len(mine), set()
        for found in words(text):
            mine.update(found)
            seen.update(found)
        docs.update(seen)
        return len(mine) - before

    def table(self) -> pa.Table:
        parts = [*(((lang, source), c) for (lang, source), c in self.counts.items()), *(((lang, None), c) for lang, c in self.held.items())]
        tables = []
        for (lang, source), found in parts:
            if found:
                key = pc.binary_join_element_wise(pa.array(found, pa.binary()), pa.scalar(lang.encode("utf-8", "surrogatepass")), pa.scalar(b"\0"))
                name = pa.scalar(None if source is None else source.encode("utf-8", "surrogatepass"), pa.binary())
                tables.append(pa.table([key, pa.repeat(name, len(found)), pa.array(found.values(), pa.int64())], schema=RUN))
        return pa.concat_tables(tables) if tables else RUN.empty_table()

    def runs(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """The block as one term-sorted run a shard; equal keys have equal shards."""
        rows = self.table().combine_chunks()
        if not len(rows):
            return
        shard = pa.array((_hashes(rows["key"].chunk(0)) % np.uint64(shards)).astype(np.int64))
        order = pc.sort_indices(rows.append_column("shard", shard), sort_keys=[("shard", "ascending"), ("key", "ascending")])
        rows, shard = rows.take(order), shard.take(order).to_numpy()
        cuts = np.flatnonzero(np.r_[True, np.diff(shard) != 0, True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(shard[a]), pack_run(rows.slice(a, b - a))


def _hashes(keys: pa.Array) -> np.ndarray:
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset:keys.offset + len(keys) + 1].astype(np.int64)
    return hash_spans(np.frombuffer(keys.buffers()[2], np.uint8), ends[:-1], ends[1:])


def pack_run(rows: pa.Table, size: int = 1 << 15) -> bytes:
    """A compressed run in batches of about ``size`` rows; no key lies in two of them."""
    sink, keys, at = pa.BufferOutputStream(), rows["key"], 0
    with pa.ipc.new_stream(sink, RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        while at < len(rows):
            end = min(len(rows), at + size)
            while end < len(rows) and keys[end] == keys[end - 1]:
                end += 1
            out.write_table(rows.slice(at, end - at).combine_chunks())
            at = end
    return sink.getvalue().to_pybytes()


class _Reader:
    """A run, one batch of it unpacked at a time."""

    def __init__(self, data: bytes):
        self.stream, self.rows = pa.ipc.open_stream(data), None
        self.ahead = next(self.stream, None)
        self.step()

    def step(self) -> None:
        self.rows, self.ahead = self.ahead, next(self.stream, None)

    def last(self) -> bytes:
        return self.rows.column(0)[-1].as_py()

    def upto(self, key: bytes | None) -> pa.RecordBatch:
        """Takes the rows up to ``key`` (None: all)."""
        n = self.rows.num_rows if key is None else bisect.bisect_right(range(self.rows.num_rows), key, key=lambda i: self.rows.column(0)[i].as_py())
        out, self.rows = self.rows.slice(0, n), self.rows.slice(n)
        return out


def merge_runs(runs: list[bytes]) -> Iterator[pa.Table]:
    """Heap-merges runs batch by batch: tables of ascending keys, every key in one of them, equal (key, source) added up.

    A heap holds the last key of every run's batch with others behind it. All rows up to the least of these can go.
    """
    readers = [r for r in map(_Reader, runs) if r.rows is not None]
    heap = [(r.last(), i) for i, r in enumerate(readers) if r.ahead is not None]
    heapq.heapify(heap)
    while any(r.rows is not None for r in readers):
        key = heap[0][0] if heap else None
        while heap and heap[0][0] == key:
            heapq.heappop(heap)
        parts = [r.upto(key) for r in readers if r.rows is not None]
        for j, r in enumerate(readers):
            if r.rows is not None and not r.rows.num_rows:
                r.step()
                if r.ahead is not None:
                    heapq.heappush(heap, (r.last(), j))
        found = pa.Table.from_batches(parts, RUN).group_by(["key", "source"]).aggregate([("n", "sum")])
        found = found.rename_columns([{"n_sum": "n"}.get(c, c) for c in found.column_names]).select(RUN.names)
        yield found.sort_by([("key", "ascending"), ("source", "ascending")])


def spill_runs(docs: DataFrame, shards: int, block: int = 400_000) -> DataFrame:
    """``shard, run``: the postings of all texts as term-sorted runs. A block holds at most ``block`` postings, and one text's."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Block(), 0
        for row in each_row(batches):
            size += held.add(*row)
            if size >= block:
                yield from (batch(SPILL, [[s], [run]]) for s, run in held.runs(shards))
                held, size = Block(), 0
        yield from (batch(SPILL, [[s], [run]]) for s, run in held.runs(shards))

    empty = F.lit("")
    return docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source", "text"))).mapInArrow(index, "shard long, run binary")


def _postings(rows: pa.Table, least_docs: int) -> pa.RecordBatch:
    """Rows of merged runs to one row a kept term."""
    of_docs = pc.is_null(rows["source"])
    kept = rows.filter(pc.and_(of_docs, pc.greater_equal(rows["n"], least_docs)))["key"]
    rows = rows.filter(pc.and_(pc.invert(of_docs), pc.is_in(rows["key"], value_set=kept))).combine_chunks()
    if not len(rows):
        return pa.RecordBatch.from_pylist([], schema=POSTINGS)
    key = rows["key"].chunk(0)
    code = key.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, np.diff(code) != 0])
    offsets = pa.array(np.r_[first, len(code)].astype(np.int32))
    parts = pc.split_pattern(key.take(pa.array(first)), b"\0", max_splits=1)
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (rows["source"].chunk(0).cast(pa.string()), rows["n"].chunk(0))]
    return pa.RecordBatch.from_arrays([pc.list_element(parts, 1).cast(pa.string()), pc.list_element(parts, 0).cast(pa.string()), *lists], schema=POSTINGS)


def merge_shards(runs: DataFrame, shards: int, least_docs: int = 3, fan_in: int = 512) -> DataFrame:
    """``lang, term, sources, counts`` of every term in at least ``least_docs`` documents of its language.

    A shard's runs arrive compressed; whenever ``fan_in`` of them are there, they become one.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine in itertools.groupby(each_row(batches, 16), key=lambda r: r[0]):
            waiting: list[bytes] = []
            for _, run in mine:
                waiting.append(run)
                if len(waiting) >= fan_in:
                    waiting = [pack_run(pa.concat_tables(merge_runs(waiting)))]
            for rows in merge_runs(waiting):
                yield _postings(rows, least_docs)

    dealt = runs.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, "lang string, term string, sources array<string>, counts array<long>")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / total)``, exact beyond 64 bits too."""
    if len(count) and int(count.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (int(c) + 1) // int(t) for c, t in zip(count, np.broadcast_to(total, count.shape))], np.int64)
    return 1 + UNIT * (count + 1) // total


def _totals(spark: SparkSession, docs: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per language its kept terms and words; per (lang, source), occurring or not in a kept term, its words."""
    empty = F.lit("")
    groups = docs.select(*(F.coalesce(c, empty).alias(c) for c in ("lang", "source"))).distinct()
    counted = postings.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p")).groupBy("lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("n"))
    langs = postings.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    held = groups.join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    return langs, held


class Corrections:
    """Sums of corrections of pairs of groups, as rows (a group against all others) and columns (all others against a group).

    At most ``most`` numbers are held; then they are handed on and begin anew.
    """

    def __init__(self, most: int = 1 << 22):
        self.most, self.held, self.sums = most, 0, {}

    def add(self, lang: str, column: bool, group: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds ``values``, a row for every element of ``group``."""
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
        for g, v in zip(group[order][first].tolist(), np.add.reduceat(values[order], first, axis=0)):
            if (lang, column, g) in self.sums:
                self.sums[lang, column, g] += v
            else:
                self.sums[lang, column, g] = v
                self.held += len(v)
        if self.held > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, column, g), v in self.sums.items():
            other = np.flatnonzero(v)
            pair = [np.full(len(other), g, np.int64), other]
            i, j = reversed(pair) if column else pair
            yield pa.RecordBatch.from_arrays([pa.repeat("pair", len(other)), pa.repeat(lang, len(other)), pa.array(i), pa.array(j), pa.nulls(len(other), pa.string()), pa.array(v[other])], schema=FOUND)
        self.sums, self.held = {}, 0


FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("term", pa.string()), ("value", pa.int64())])


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def stream_postings(batches: Iterator[pa.RecordBatch], groups: dict, cells: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of groups, and terms whose share in a group is above the language's, as rows of ``FOUND``.

    ``groups`` maps a language to its numbered sources, their totals, their shares of an absent term, and its own total.
    """
    sums = Corrections()
    for b in batches:
        for lang in b.column(0).unique().to_pylist():
            number, total, p0, lang_total = groups[lang]
            mine = b.filter(pc.equal(b.column(0), pa.scalar(lang)))
            step = max(1, cells // len(total))
            for rows in (mine.slice(at, step) for at in range(0, mine.num_rows, step)):
                lists = rows.column(2)
                t = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                g = np.array([number[x] for x in lists.flatten().to_pylist()], np.int64)
                n = rows.column(3).flatten().to_numpy(zero_copy_only=False)
                p = share(n, total[g])
                q = share(np.add.reduceat(n, np.flatnonzero(np.r_[True, np.diff(t) != 0])), np.full(rows.num_rows, lang_total))[t]
                high = np.flatnonzero(p > q)
                yield pa.RecordBatch.from_arrays([pa.repeat("term", len(high)), pa.repeat(lang, len(high)), pa.array(g[high]), pa.nulls(len(high), pa.int64()),
                                                  rows.column(1).take(pa.array(t[high])), pa.array(_gap(p[high], q[high]))], schema=FOUND)
                if len(total) == 1:
                    continue
                every = np.tile(p0, (rows.num_rows, 1))
                every[t, g] = p
                absent = np.ones(every.shape, bool)
                absent[t, g] = False
                wide = max(1, cells // len(total))
                for at in range(0, len(g), wide):
                    ts, gs, ps = t[at:at + wide], g[at:at + wide], p[at:at + wide, None]
                    yield from sums.add(lang, False, gs, _gap(ps, every[ts]) - _gap(p0[gs, None], p0[None, :]))
                    yield from sums.add(lang, True, gs, np.where(absent[ts], _gap(p0[None, :], ps) - _gap(p0[None, :], p0[gs, None]), 0))
    yield from sums.flush()


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, shards: int | None = None, block: int = 400_000) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs in ``docs`` (text, lang, source; others are not read).

    Terms are stretches of letters A-Z, a-z and all characters beyond ASCII, only A-Z lower-cased. A language keeps the terms in at least
    ``least_docs`` of its rows. With a term's count c, the sum N of a group's counts and V kept terms, its share
    is ``p = 1 + floor(10^9 * (c + 1) / (N + V))`` in the group and, from the counts of the whole language, q there.
    Part ``pair``: every other source of the language with the sum of ``floor((p - q)^2 / q)`` over all kept terms, q being
    the other's share; 0 without kept terms. Part ``term``: the ``top`` terms of the group with p above the language's q, and that value.
    Ranks go by falling value, then item. Null text, lang and source are empty strings; repeated rows count each; an empty table gives no rows.
    Sources are categories: a row of each (lang, source) goes to the driver and, as numbers, to the tasks; pairs are as many as their squares.
    """
    spark = docs.sparkSession
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = cut_lineage(merge_shards(cut_lineage(spill_runs(docs, shards, block)), shards, least_docs))
    langs, held = (cut_lineage(x) for x in _totals(spark, docs, postings))
    by_lang = {r["lang"]: (r["v"], r["lang_n"]) for r in langs.collect()}
    listed = defaultdict(list)
    for r in held.orderBy("lang", "source").collect():
        listed[r["lang"]].append((r["source"], r["n"]))
    groups, zeros = {}, []
    for lang, rows in listed.items():
        v, lang_n = by_lang.get(lang, (0, 0))
        total = np.array([n + v for _, n in rows], np.int64)
        p0 = share(np.zeros(len(rows), np.int64), np.maximum(total, 1))
        groups[lang] = ({s: i for i, (s, _) in enumerate(rows)}, total, p0, lang_n + v)
        zeros += [(lang, i, s, int(p), v) for i, ((s, _), p) in enumerate(zip(rows, p0.tolist()))]
    known = spark.sparkContext.broadcast(groups)
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream_postings(batches, known.value)

    found = cut_lineage(postings.mapInArrow(stream, "part string, lang string, i long, j long, term string, value long"))
    named = spark.createDataFrame(zeros, "lang string, i long, source string, p0 long, v long")
    fixes = found.where("part = 'pair'").groupBy("lang", "i", "j").agg(F.sum("value").alias("fix"))
    mine, other = named.toDF("lang", "i", "source", "p", "v"), named.select("lang", F.col("i").alias("j"), F.col("source").alias("item"), F.col("p0").alias("q"))
    # every pair of sources of a language is a row of the result
    pairs = mine.join(other, "lang").where("i <> j").join(fixes, ["lang", "i", "j"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.expr("v * ((p - q) * (p - q) div q)") + F.coalesce("fix", F.lit(0))).cast("long").alias("value"))
    above = found.where("part = 'term'").select("lang", "i", F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = best.join(F.broadcast(named.select("lang", "i", "source")), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.unionByName(words)
