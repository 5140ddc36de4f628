"""Mixing sources to target weights by fixed-length blocks of words.

The words of a source lie one after the other (by doc_id) and are cut into blocks. Every output shard draws
how many blocks it takes of each source from a multinomial; the running count of a source over the shards
gives slots 0, 1, 2, ... A slot is mapped to a block by a pseudorandom permutation of the source's block
numbers, a new one for every pass over the source, and the block is joined by its number. Nothing is
sampled on the driver and a repeated run draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import WORD, batch, each_row, running_starts
from .shingles import mix

FACTS = pa.schema([("rank", pa.int64()), ("_source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("slots", pa.int64()), ("blocks", pa.int64())])
#: Fixed values of the contract: weights in code point order of the sources, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], total: float, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Shares ``total`` by weight. What exceeds ``most`` times a size is shared anew among the others."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        all_w = sum(w[i] for i in free)
        full = {i for i in free if left * w[i] / all_w > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * w[i] / all_w
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        free -= full
    return out


def permute(i: np.ndarray, n: int, key: tuple[int, ...], back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, or its inverse: four Feistel rounds on the next even number of bits,
    repeated until the result is below ``n``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    seed = np.array([0x5851F42D4C957F2D], np.uint64)
    for k in key:
        seed = mix(seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    seeds = [mix(seed + np.uint64(r + 1)) for r in range(4)]
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> shift, x[todo] & mask
        for s in reversed(seeds) if back else seeds:
            left, right = (right ^ (mix(left + s) & mask), left) if back else (right, left ^ (mix(right + s) & mask))
        x[todo] = (left << shift) | right
        todo = x >= n
    return x.astype(np.int64)


class Source:
    """What the mix takes of one source: ``slots`` blocks, the last one cut to ``last`` words."""

    def __init__(self, rank: int, name: str | None, size: int, target: float, block: int, seed: int):
        self.rank, self.name, self.size, self.target, self.block, self.seed = rank, name, size, target, block, seed
        self.blocks = -(-size // block)
        self.words = min(int(target + 0.5), 2 * size)
        passes, rest = divmod(self.words, size) if size else (0, 0)
        slots, self.cut = -(-rest // block), 0
        if rest:
            # the source's last block is shorter; whether it comes early decides how many blocks fill the rest
            lack = self.blocks * block - size
            early = lack and permute(np.array([self.blocks - 1]), self.blocks, (seed, rank, passes), back=True)[0] < slots
            if early and slots * block - lack < rest:
                slots += 1
            self.cut = slots * block - (lack if early else 0) - rest
        self.slots = passes * self.blocks + slots

    def order(self, epoch: int, i: np.ndarray) -> np.ndarray:
        return permute(i, self.blocks, (self.seed, self.rank, epoch))


def with_sizes(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def plan(sized: DataFrame, share: float = 1.5, most: float = 2.0, block_words: int = 128, shard_slots: int = 4096, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(rows, pieces)``: rows with ``rank, start, source_size, target``; pieces of rows that the mix takes:
    ``rank, start, shard, slot, epoch, begin, end`` (words of the row).

    One row per source goes to the driver (sources are categories); nothing else does.
    """
    spark = sized.sparkSession
    placed = cut_lineage(running_starts(sized, "source", ["doc_id"], "size"))
    totals = sorted(((r.source, r.n) for r in placed.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goal = targets([n for _, n in totals], share * sum(n for _, n in totals), most)
    sources = [Source(i, s, n, t, block_words, seed) for i, ((s, n), t) in enumerate(zip(totals, goal))]
    # an Arrow table: rows given as tuples would start Python workers of their own, which stay for a minute
    facts = spark.createDataFrame(pa.Table.from_arrays([pa.array([getattr(s, at) for s in sources], FACTS.field(i).type) for i, at in enumerate(("rank", "name", "size", "target", "slots", "blocks"))], schema=FACTS))
    rows = placed.join(F.broadcast(facts.drop("slots", "blocks")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # blocks of every row: a row and a block meet in one piece
    filled = rows.where("size > 0").select("rank", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block_words).cast("long"))).alias("block"))
    filled = filled.select("rank", "block", "start", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")).alias("from_word"), F.least("size", (F.col("block") + 1) * block_words - F.col("start")).alias("to_word"))

    # counts of every shard, running slots of every source
    all_slots = sum(s.slots for s in sources)
    shards = -(-all_slots // shard_slots)
    chance = np.array([s.slots for s in sources], float) / max(1, all_slots)
    drawn = pa.schema([("shard", pa.int64()), ("rank", pa.int64()), ("n", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            if ids:
                counts = np.stack([np.random.default_rng((seed, i)).multinomial(shard_slots, chance) for i in ids])
                yield batch(drawn, [np.repeat(ids, len(chance)), np.tile(np.arange(len(chance)), len(ids)), counts.ravel()])

    counts = cut_lineage(spark.range(0, shards, 1, max(1, min(shards, spark.sparkContext.defaultParallelism))).mapInArrow(draw, "shard long, rank long, n long")) if sources and shards else spark.createDataFrame([], "shard long, rank long, n long")
    many = F.floor(F.col("shard") / 1024)
    span = Window.unboundedPreceding, -1
    groups = counts.groupBy("rank", many.alias("many")).agg(F.sum("n").alias("n"))
    groups = groups.select("rank", "many", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("many").rowsBetween(*span)), F.lit(0)).alias("before"))
    inner = counts.select("*", many.alias("many"), F.coalesce(F.sum("n").over(Window.partitionBy("rank", many).orderBy("shard").rowsBetween(*span)), F.lit(0)).alias("inner"))
    runs = inner.join(groups, ["rank", "many"]).select("shard", "rank", (F.col("before") + F.col("inner")).alias("first"), "n")
    # a source drawn too often stops at its slots; one drawn too seldom gets the rest in shards behind
    got = counts.groupBy("rank").agg(F.sum("n").alias("first"))
    few = F.broadcast(facts.select("rank", "slots"))
    rest = got.join(few, "rank").where("first < slots").select((F.lit(shards) + F.col("rank")).alias("shard"), "rank", "first", (F.col("slots") - F.col("first")).alias("n"))
    runs = runs.unionByName(rest).join(few, "rank").select("shard", "rank", "first", F.least("slots", F.col("first") + F.col("n")).alias("stop")).where("first < stop")
    slots = runs.repartition("shard", "rank").select("shard", "rank", F.explode(F.sequence("first", F.col("stop") - 1)).alias("slot"))
    mapped = pa.schema([("shard", pa.int64()), ("rank", pa.int64()), ("slot", pa.int64()), ("epoch", pa.int64()), ("block", pa.int64()), ("cut", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, slot = (b.column(i).to_numpy() for i in (1, 2))
            epoch, block, cut = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for r in np.unique(rank):
                s, mine = sources[r], rank == r
                epoch[mine] = slot[mine] // s.blocks
                for e in np.unique(epoch[mine]):
                    now = mine & (epoch == e)
                    block[now] = s.order(int(e), slot[now] % s.blocks)
                cut[mine & (slot == s.slots - 1)] = s.cut
            yield batch(mapped, [b.column(0), rank, slot, epoch, block, cut])

    taken = slots.mapInArrow(place, "shard long, rank long, slot long, epoch long, block long, cut long")
    # the words cut from a source's last slot come off the end of its block
    ends = F.least(F.col("size_"), (F.col("block") + 1) * block_words) - F.col("cut")
    # Spark cannot foresee how many slots the few counts unfold to: without the hint it would broadcast them
    pieces = taken.hint("merge").join(filled, ["rank", "block"]).join(F.broadcast(facts.select("rank", F.col("source_size").alias("size_"))), "rank")
    pieces = pieces.select("rank", "start", "shard", "slot", "epoch", F.col("from_word").alias("begin"), F.least("to_word", ends - F.col("start")).alias("end")).where("begin < end")
    return rows, pieces


def mix_taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    A source's taken words are its target, rounded. Rows without words take none; equal rows each have their own
    words; null sources are one source, the last; an empty table gives no rows.
    """
    rows, pieces = plan(with_sizes(docs), **options)
    taken = pieces.groupBy("rank", "start").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("taken")).select(F.col("rank").alias("_rank"), F.col("start").alias("_start"), "taken")
    out = rows.join(taken.hint("merge"), (F.col("rank") == F.col("_rank")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with their columns: one row for every pass that takes words of a document.

    The text holds those words in order with the white space between them (all of it where the pass takes the whole
    document), ``n_chars`` its length. A document whose blocks come in two passes gives two rows. Rows equal in
    doc_id and text are planned once and return alike; rows without words have nothing to give.
    """
    key = F.xxhash64("text").alias("_hash")
    rows, pieces = plan(with_sizes(docs, key).distinct(), **options)
    spans = pieces.groupBy("rank", "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    wanted = rows.where("size > 0").select(F.col("doc_id").alias("_mix_doc"), F.col("source").alias("_mix_source"), F.col("_hash").alias("_mix_of"), "rank", "start", F.col("size").alias("_mix_size")).join(spans.hint("merge"), ["rank", "start"])
    wanted = cut_lineage(wanted.select("_mix_doc", "_mix_source", "_mix_of", "_mix_size", F.col("spans.begin").alias("_mix_begin"), F.col("spans.end").alias("_mix_end")))
    at = [c for c in docs.columns if c not in ("text", "n_chars")]
    met = docs.withColumn("_mix_hash", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_mix_doc")) & F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_hash") == F.col("_mix_of")))

    @F.arrow_udf("string")
    def words_of(text: pa.Array, size: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
        import re

        out = []
        for t, n, bs, es in each_row([pa.RecordBatch.from_arrays([text, size, begin, end], names=list("tnbe"))], 64):
            joined: list[list[int]] = []
            for b, e in zip(bs, es):
                if joined and joined[-1][1] == b:
                    joined[-1][1] = e
                else:
                    joined.append([b, e])
            if joined == [[0, n]]:
                out.append(t)
            else:
                spots = [m.span() for m in re.finditer(WORD, t)]
                out.append("\n".join(t[spots[b][0]:spots[e - 1][1]] for b, e in joined))
        return pa.array(out, pa.string())

    cut = met.withColumn("text", words_of("text", "_mix_size", "_mix_begin", "_mix_end"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else cut.select(docs.columns)
