"""Exact Jaccard join of documents as sets of word shingles, by skipping over set relations.

Shingles are put in one global order, rarest first. A document files only the shingles of its
prefix (those that a partner must share one of) that another document can have at all; most
documents file none. The lists are worked through in two steps:

* Every member of a list is compared with the list's leader. Of near copies this links all
  or nearly all at a linear cost, and leaves each with a computed answer (its overlap with a leader).
* Members that these links do not connect yet are compared in blocks of a list, ordered by size
  and position, and whole blocks are skipped by their bounds. A pair with the same leader gets its
  answer from the two computed ones where the bounds settle it; only the rest is verified.

Results are those of comparing all pairs: no list is cut and no candidate dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut_lineage
from .common import batch, by_bytes, components, small_batches
from .shingles import set_id, shingle_sets
from .tokens import forget

#: Bits of the table of shared shingles, of the table of their frequency classes, and of a set's sketch.
SHARED_BITS, LEVEL_BITS, SKETCH = 27, 22, 2048
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sketch", pa.binary()), ("token", pa.list_(pa.int64())), ("pos", pa.list_(pa.int64())), ("text_hash", pa.int64())])


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """Smallest overlap of two linked sets of these sizes."""
    return F.ceil(percent * (n1 + n2) / F.lit(100 + percent)).cast("long")


def shared_tables(docs: DataFrame, k: int, range_bits: int = 8, flush_at: int = 1_000_000) -> tuple[bytes, bytes]:
    """Which shingles two sets may share (one bit by hash), and how frequent they are (a class by hash).

    Tasks send the sorted distinct shingles of their documents (``flush_at`` at a time), packed by hash range; a range is counted by one
    task. The tables have a fixed size and only order the shingles: a wrong bit costs a list entry, never a pair.
    """
    import zstandard

    ranges = 1 << range_bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size, seen = [], 0, set()
        pack = zstandard.ZstdCompressor(level=1).compress

        def flush():
            # 40 bits tell shingles apart well enough for counting
            keys, counts = np.unique(np.concatenate(held) >> np.uint64(24), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(40 - range_bits))
            rows = []
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                if b > a:
                    low = (keys[a:b] & np.uint64((1 << (40 - range_bits)) - 1)).astype(np.uint32)
                    gaps = np.diff(low, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
                    rows.append((r, pack(gaps.T.tobytes()), pack(np.minimum(counts[a:b], 65535).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["r", "gaps", "counts"])

        for b in batches:
            for _, run in by_bytes(b.column(0), 1 << 18):
                for s in shingle_sets(run, k):
                    if len(s) and (c := set_id(s)) not in seen:
                        seen.add(c)
                        held.append(s)
                        size += len(s)
                if size >= flush_at:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def tally(key, sent):
        unpack = zstandard.ZstdDecompressor().decompress
        low, counts = [], []
        for x, c in zip(sent.column("gaps").to_pylist(), sent.column("counts").to_pylist()):
            low.append(np.cumsum(np.ascontiguousarray(np.frombuffer(unpack(x), np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32))
            counts.append(np.ascontiguousarray(np.frombuffer(unpack(c), np.uint8).reshape(2, -1).T).view("<u2").ravel())
        low, counts = np.concatenate(low), np.concatenate(counts).astype(np.int64)
        order = np.argsort(low, kind="stable")
        low = low[order]
        begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        df, low = np.add.reduceat(counts[order], begin), low[begin]
        low, df = low[df > 1], df[df > 1]
        bits = np.zeros(1 << (SHARED_BITS - range_bits), bool)
        bits[low >> (40 - SHARED_BITS)] = True
        levels = np.zeros(1 << (LEVEL_BITS - range_bits), np.uint8)
        np.maximum.at(levels, low >> (40 - LEVEL_BITS), np.log2(df).astype(np.uint8))
        return pa.table({"r": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(bits).tobytes()], "levels": [levels.tobytes()]})

    sent = docs.select("text").mapInArrow(send, "r int, gaps binary, counts binary")
    got = sent.groupBy("r").applyInArrow(tally, "r int, bits binary, levels binary").toArrow()
    at = {r: i for i, r in enumerate(got["r"].to_pylist())}
    none = {"bits": bytes(1 << (SHARED_BITS - range_bits - 3)), "levels": bytes(1 << (LEVEL_BITS - range_bits))}
    return tuple(b"".join(got[c][at[r]].as_buffer() if r in at else none[c] for r in range(ranges)) for c in ("bits", "levels"))


def file_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row ``doc_id, n, cls`` (fingerprint of its set), a sketch and its list entries (empty for most), and ``text_hash``."""
    tables = docs.sparkSession.sparkContext.broadcast(shared_tables(docs, k))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        bits, levels = (np.frombuffer(x, np.uint8) for x in tables.value)
        seen: set[int] = set()
        for b in batches:
            ids, hashes, rows = b.column(0).to_pylist(), b.column(2).to_pylist(), []
            for at, run in by_bytes(b.column(1), 1 << 18):
                for i, s in enumerate(shingle_sets(run, k)):
                    n, c, sketch, token, pos = len(s), set_id(s), None, [], []
                    if n and c not in seen:
                        seen.add(c)
                        high = s >> np.uint64(64 - SHARED_BITS)
                        shared = (bits[(high >> np.uint64(3)).astype(np.int64)] >> (7 - (high & np.uint64(7)).astype(np.uint8))) & 1
                        prefix = n - (percent * n + 99) // 100 + 1
                        # shingles that nothing shares come first and need no entry
                        alone = n - int(shared.sum())
                        if alone < prefix:
                            own = s[shared == 1]
                            level = levels[(own >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)]
                            token = own[np.argsort(level, kind="stable")][:prefix - alone].view(np.int64).tolist()
                            pos = list(range(alone, alone + len(token)))
                            sketch = np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()
                    rows.append((ids[at + i], n, c, sketch, token, pos, hashes[at + i]))
            if rows:
                yield batch(SETS, list(zip(*rows)))

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(file, "doc_id long, n long, cls long, sketch binary, token array<long>, pos array<long>, text_hash long")
    stored = cut_lineage(rows)
    # nothing reads them again: the driver and the executors need not hold them for the rest of the job
    tables.destroy()
    return stored


@F.arrow_udf(T.LongType())
def _differ(a: pa.Array, b: pa.Array) -> pa.Array:
    """Bits in which two sketches differ: no more than the elements in which the sets differ."""
    if not len(a):
        return pa.array([], pa.int64())
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64))


def _promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y, nx, ny`` whose sketches do not rule out a link, with ``differ``."""
    for s, to in (("x", "sx"), ("y", "sy")):
        pairs = pairs.join(sketches.select(F.col("cls").alias(s), F.col("sketch").alias(to)), s)
    rows = pairs.withColumn("differ", _differ("sx", "sy")).drop("sx", "sy")
    return rows.where(F.col("differ") <= F.col("nx") + F.col("ny") - 2 * _need(F.col("nx"), F.col("ny"), percent))


def _overlaps(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Pairs with their exact ``overlap``; the sets are built anew from one document of each class."""
    needed = pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct()
    needed = cut_lineage(needed.join(classes, "cls").select(F.col("doc_id").alias("_id"), "cls"))
    # a stored table of known size: Spark broadcasts it where it is small, else it shuffles
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(needed, F.col("doc_id").eqNullSafe(F.col("_id"))).select("cls", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            wanted = b.column(0).to_pylist()
            for at, run in by_bytes(b.column(1), 1 << 18):
                rows = [(c, s.view(np.int64)) for c, s in zip(wanted[at:], shingle_sets(run, k)) if set_id(s) == c]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["cls", "set"])

    sets = cut_lineage(texts.mapInArrow(build, "cls long, set array<long>").dropDuplicates(["cls"]))
    for s, to in (("x", "set_x"), ("y", "set_y")):
        pairs = pairs.join(sets.select(F.col("cls").alias(s), F.col("set").alias(to)), s)
    return pairs.withColumn("overlap", F.size(F.array_intersect("set_x", "set_y")).cast("long")).drop("set_x", "set_y")


def _block_pairs(lists: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Pairs of members of a list that are in different components and may be linked, each once.

    A list is dealt out by size band (a partner is in the same band or the next) and, where long, into
    pairs of parts of about ``block`` members. In a task the members are ordered by size and position,
    and runs of them are skipped by their least and greatest values.
    """
    width = float(np.log(100 / percent))
    rows = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long"))
    sizes = rows.groupBy("token").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("parts"))
    rows = rows.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("group_band", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    rows = rows.select("token", "group_band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "band", "n", "pos", "cls", "comp")
    keys = ["token", "group_band", "i", "j"]
    out = pa.schema([(c, pa.int64()) for c in ("x", "y", "nx", "ny")])
    runs = 64

    def compare(g: dict[str, np.ndarray]) -> list[np.ndarray]:
        order, found = np.lexsort((g["pos"], g["n"])), []
        g = {c: v[order] for c, v in g.items()}
        cuts = [slice(a, a + runs) for a in range(0, len(g["n"]), runs)]
        heads = [(g["n"][c][0], g["n"][c][-1], (g["n"][c] - g["pos"][c]).max()) for c in cuts]
        for p, a in enumerate(cuts):
            for q in range(p, len(cuts)):
                b = cuts[q]
                # the smallest partner is too large for the whole block, or too little is left behind the position
                if heads[q][0] * percent > heads[p][1] * 100:
                    break
                if min(heads[p][2], heads[q][2]) * (100 + percent) < percent * (heads[p][0] + heads[q][0]):
                    continue
                na, nb = g["n"][a][:, None], g["n"][b][None, :]
                left = np.minimum(na - g["pos"][a][:, None], nb - g["pos"][b][None, :])
                ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (left * (100 + percent) >= percent * (na + nb))
                ok &= g["comp"][a][:, None] != g["comp"][b][None, :]
                ok &= np.minimum(g["band"][a][:, None], g["band"][b][None, :]) == g["group_band"][0]
                if g["i"][0] != g["j"][0]:
                    ok &= g["part"][a][:, None] != g["part"][b][None, :]
                if p == q:
                    ok = np.triu(ok, 1)
                u, v = np.nonzero(ok)
                if len(u):
                    cu, cv, nu, nv = g["cls"][a][u], g["cls"][b][v], g["n"][a][u], g["n"][b][v]
                    swap = cu > cv
                    found.append(np.stack([np.where(swap, cv, cu), np.where(swap, cu, cv), np.where(swap, nv, nu), np.where(swap, nu, nv)]))
        return found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def groups(g: dict[str, np.ndarray], last: bool):
            change = np.any([g[c][1:] != g[c][:-1] for c in keys], axis=0)
            edge = np.r_[0, np.flatnonzero(change) + 1, len(g["n"])]
            found = []
            for a, b in zip(edge[:-1], edge[1:] if last else edge[1:-1]):
                if b - a > 1:
                    found += compare({c: v[a:b] for c, v in g.items()})
            rest = None if last else {c: v[edge[-2]:] for c, v in g.items()}
            return found, rest

        def emit(found):
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            return batch(out, list(pairs))

        for b in batches:
            if not b.num_rows:
                continue
            now = {c: b.column(i).to_numpy() for i, c in enumerate(b.schema.names)}
            held = now if held is None else {c: np.concatenate((held[c], now[c])) for c in now}
            found, held = groups(held, False)
            if found:
                yield emit(found)
        if held is not None:
            found, _ = groups(held, True)
            if found:
                yield emit(found)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(walk, "x long, y long, nx long, ny long").dropDuplicates(["x", "y"])


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two rows link when ``100 * |intersection| >= percent * |union|`` of their sets; ``component_id`` is the smallest
    doc_id that links reach. Empty and null texts have empty sets and link with nothing. Equal sets always link;
    they are one class and are not expanded. Equal rows each keep a row. A null doc_id is never the smallest
    unless all are null. Other columns are not read.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of ``jaccard_components`` with ``text_hash`` and ``group``, a number of the component (null for empty sets)."""
    sets = file_sets(docs, k, percent)
    classes = cut_lineage(sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("sketch").alias("sketch")))
    entries = sets.where(F.size("token") > 0).select("cls", "n", F.element_at("pos", 1).alias("alone"), F.explode(F.arrays_zip("token", "pos")).alias("e"))
    entries = entries.select(F.col("e.token").alias("token"), "cls", "n", F.col("e.pos").alias("pos"), "alone").dropDuplicates(["token", "cls"])
    # the leader is the member with the fewest shingles of its own: the likeliest original of near copies
    several = entries.groupBy("token").agg(F.min(F.struct("alone", "cls", "n")).alias("lead"), F.min("cls").alias("one"), F.max("cls").alias("last")).where("one <> last")
    lists = cut_lineage(entries.join(several, "token").select("token", "cls", "n", "pos", F.col("lead.cls").alias("lead"), F.col("lead.n").alias("lead_n")))
    sketches = classes.where("sketch is not null").select("cls", "sketch")

    # with the leader
    led = lists.where("cls <> lead").select(F.col("lead").alias("x"), F.col("cls").alias("y"), F.col("lead_n").alias("nx"), F.col("n").alias("ny"))
    led = led.where((100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))).distinct()
    best = _promising(led, sketches, percent).groupBy("y").agg(F.min(F.struct("differ", "x", "nx", "ny")).alias("b")).select("b.x", "y", "b.nx", "b.ny")
    answers = cut_lineage(_overlaps(cut_lineage(best), classes, docs, k))
    linked = F.col("overlap") >= _need(F.col("nx"), F.col("ny"), percent)
    links = answers.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = cut_lineage(components(links))

    # what these links leave apart
    placed = lists.join(first.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left").select("token", "cls", "n", "pos", F.coalesce("comp", "cls").alias("comp"))
    apart = placed.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    pairs = _block_pairs(placed.join(apart, "token"), percent)
    known = answers.select(F.col("y").alias("cls"), F.col("x").alias("lead"), "overlap")
    for s in ("x", "y"):
        pairs = pairs.join(known.select(F.col("cls").alias(s), F.col("lead").alias(f"lead_{s}"), F.col("overlap").alias(f"o_{s}")), s, "left")
    leader_size = answers.select(F.col("x").alias("lead_x"), F.col("nx").alias("lead_n")).distinct()
    pairs = pairs.join(leader_size, "lead_x", "left")
    need, same = _need(F.col("nx"), F.col("ny"), percent), F.col("lead_x") == F.col("lead_y")
    most = F.least("o_x", "o_y") + F.least(F.col("nx") - F.col("o_x"), F.col("ny") - F.col("o_y"))
    least = F.col("o_x") + F.col("o_y") - F.col("lead_n")
    judged = cut_lineage(pairs.select("x", "y", "nx", "ny", F.when(same & (least >= need), 1).when(same & (most < need), -1).otherwise(0).alias("answer")))
    open_pairs = cut_lineage(_promising(judged.where("answer = 0").drop("answer"), sketches, percent).drop("differ"))
    late = _overlaps(open_pairs, classes, docs, k).where(linked).select("x", "y")
    # the first links go in as their components: stars, which link the same
    stars = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    comps = components(stars.union(judged.where("answer = 1").select("x", "y")).union(late))

    placed = classes.select("cls", "doc_id").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least_id = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = placed.join(least_id, "component").select(F.col("cls").alias("_cls"), F.col("component").alias("group"), "component_id")
    joined = sets.select("doc_id", "n", "cls", "text_hash").join(by_class, (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "group")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row of every component, with all columns: that of the smallest doc_id, a null one last, then of the least text hash.

    Of rows with the same doc_id and text one stays. Rows with empty sets are alone and stay. Rows go by doc_id and text
    hash: a null or repeated doc_id takes no other text along. Only these two of the rows that go are joined with
    the documents: a stored table, which Spark broadcasts while it is small.
    """
    with small_batches(docs.sparkSession):
        groups = cut_lineage(_components(docs, k, percent).select("doc_id", "text_hash", "group"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = groups.where("group is not null").groupBy("group").agg(F.min(first).alias("stays"))
    other = ~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash")))
    gone = cut_lineage(groups.join(stays, "group").where(other).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    kept = docs.join(gone, met, "left_anti")
    again = cut_lineage(groups.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return kept
    return kept.join(again, met, "left_anti").unionByName(kept.join(again, met, "left_semi").dropDuplicates(["doc_id", "text"]))
