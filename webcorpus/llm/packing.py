"""Retrieval packing: a BM25 index per shard returns unused neighbours of a seed document, which fill its window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import batch, by_bytes, crc32_of, each_row, small_batches
from .shingles import mix
from .tokens import WordEncoder, forget, give_back, tokenizer_path

IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), ("look", pa.int64()), ("frequencies", pa.binary())])
PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
#: Usual BM25 constants.
K1, B = 1.2, 0.75


class Bm25:
    """Inverted index of one shard: lists by token id, with the finished weight of every entry."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int):
        terms, counts, owners = [], [], []
        self.query: list[np.ndarray] = []
        for i, d in enumerate(docs):
            # ids of two bytes are sorted by their digits
            t = np.sort(d, kind="stable")
            first = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
            t, c = t[first[:-1]], first[1:] - first[:-1]
            known = idf[t]
            keep = known > 0
            t, c = t[keep], c[keep]
            w = known[keep] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(d) / mean_length))
            self.query.append(t[np.argsort(-w, kind="stable")[:query_terms]])
            terms.append(t)
            counts.append(w)
            owners.append(np.full(len(t), i, np.int32))
        t = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        order = np.argsort(t, kind="stable")
        self.n, self.owner, self.weight = len(docs), np.concatenate(owners)[order], np.concatenate(counts)[order]
        self.start = np.searchsorted(t[order], np.arange(len(idf) + 1))

    def ranking(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share one of the seed's most telling terms, best first."""
        q = self.query[seed]
        a, n = self.start[q], self.start[q + 1] - self.start[q]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(q) else np.zeros(0, np.int64)
        score = np.bincount(self.owner[at], self.weight[at], self.n)
        score[used] = 0
        best = np.flatnonzero(score > 0)
        return best[np.argsort(-score[best], kind="stable")]


def pack_shard(docs: list[np.ndarray], index: Bm25, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). All but the last are full.

    A seed's unused neighbours follow it in order of their scores until the window is full; a document that is cut there
    opens the next window as its seed. Without a neighbour the next unused document follows.
    """
    used, out, now, room, first = np.zeros(len(docs), bool), [], [], window, 0
    for _ in range(len(docs)):
        while first < len(docs) and used[first]:
            first += 1
        if first == len(docs):
            break
        todo, waiting = [first], iter(())
        while todo:
            i = todo.pop()
            used[i], at = True, 0
            while at < len(docs[i]):
                n = min(room, len(docs[i]) - at)
                now.append((i, at, n))
                at, room = at + n, room - n
                if not room:
                    out.append(now)
                    now, room = [], window
                    # what follows in the new window is sought for the document that opens it
                    waiting = None
            if room == window:
                break
            if waiting is None or len(now) == 1:
                waiting = iter(index.ranking(now[0][0], used))
            todo += [j for j in (next((j for j in waiting if not used[j]), None),) if j is not None]
    return [*out, now] if now else out


def split_last(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two, which need no padding."""
    left, out = sum(n for *_, n in pieces), []
    queue = list(reversed(pieces))
    while left:
        room, now = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            i, at, n = queue.pop()
            now.append((i, at, min(n, room)))
            if n > room:
                queue.append((i, at + room, n - room))
            room -= now[-1][2]
        out.append(now)
    return out


def encode_documents(docs: DataFrame, model: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """``doc_id, ids`` (little-endian bytes, end id last), ``n`` and ``look``, a min-hash of the ids: documents that share many ids often share it.

    The last row of every task holds ``frequencies`` alone: for each id of the vocabulary (4 little-endian bytes), the task's documents with it.
    """
    path = tokenizer_path(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(path)
        size = encoder.tk.get_vocab_size()
        end, rank = np.array([end_id], encoder.dtype), mix(np.arange(1, size + 1, dtype=np.uint64))
        # least hash of the pairs of an id and a second hash: spreads the documents of one first value
        rank2 = (mix(rank + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
        rank = (rank >> np.uint64(33)).astype(np.uint32)
        frequencies, place, any_rows = np.zeros(size, "<u4"), np.zeros(size, np.int32), False
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, run in by_bytes(b.column(1), 1 << 17):
                docs = encoder.encode(run)
                n = np.array([len(x) + 1 for x in docs])
                t = np.concatenate([x for d in docs for x in (d, end)])
                stops = np.cumsum(n)
                look = np.minimum.reduceat(rank[t], stops - n).astype(np.int64) << 32 | np.minimum.reduceat(rank2[t], stops - n)
                parts = [t[e - k:e] for e, k in zip(stops.tolist(), n.tolist())]
                for x in parts:
                    # of the places of one id in a document, a single one stays
                    own = np.arange(len(x), dtype=np.int32)
                    place[x] = own
                    frequencies[x[place[x] == own]] += 1
                yield batch(IDS, [ids[at:at + len(run)], [x.tobytes() for x in parts], n, look, [None] * len(run)])
                any_rows = True
        if any_rows:
            yield batch(IDS, [[None], [None], [None], [None], [frequencies.tobytes()]])
        # a worker that waits for its next task keeps the encoder alone
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, ids binary, n long, look long, frequencies binary")


def pack(docs: DataFrame, window: int = 1024, model: str = "byte_bpe_50k.json", end_id: int = 0, shard_docs: int = 1024, shard_tokens: int = 4_000_000, query_terms: int = 24) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: pieces of sequences of at most ``window`` ids.

    Ids are stored once. Document frequencies count all documents, where they are encoded (one number per id of the vocabulary and
    task, which bounds the broadcast). Documents are dealt out by ranges of their min-hash, ties by doc_id, so that like ones come together and no value
    can overload a task; a task indexes ``shard_docs`` documents (or ``shard_tokens`` ids) at a time. A seed asks with its
    ``query_terms`` most telling ids. Terms in more than half of the documents weigh nothing, as usual for BM25. The rest of a shard that
    fills no window is cut into powers of two, so nothing is padded. A null or empty text has its end id alone;
    equal rows stay apart; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        stored = cut_lineage(encode_documents(docs, model, end_id))
    coded = stored.where("frequencies IS NULL")
    # the tasks know the vocabulary: the driver needs only its size
    n_docs, n_ids, size = (x or 0 for x in stored.agg(F.count_if(F.col("frequencies").isNull()), F.sum("n"), F.floor(F.max(F.octet_length("frequencies")) / 4)).first())
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        df = np.zeros(size, np.int64)
        for x, in each_row(batches, 16):
            df += np.frombuffer(x, "<u4")
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["token", "df"])

    df = np.zeros(max(size, end_id + 1))
    got = stored.where("frequencies IS NOT NULL").select("frequencies").mapInArrow(summed, "token int, df long").groupBy("token").agg(F.sum("df").alias("df")).toArrow()
    df[got["token"].to_numpy()] = got["df"].to_numpy()
    idf = np.maximum(0, np.log((n_docs - df + 0.5) / (df + 0.5)))
    idf[df == 0] = 0
    idf[end_id] = 0
    known, mean_length = spark.sparkContext.broadcast(idf), max(1.0, n_ids / max(1, n_docs))
    cols = [F.col("look"), F.col("doc_id").asc_nulls_last(), F.xxhash64("ids")]
    dealt = coded.repartitionByRange(*cols).sortWithinPartitions(*cols).select("doc_id", "ids")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # all texts are encoded: the room is for the index now
        forget()
        next_id, held, names, tokens = TaskContext.get().partitionId() << 40, [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal next_id
            sequences = pack_shard(held, Bm25(held, known.value, mean_length, query_terms), window)
            if sequences and sum(n for *_, n in sequences[-1]) < window:
                sequences[-1:] = split_last(sequences[-1])
            wide, rows = [d.astype("<u4") for d in held], []
            for s in sequences:
                offset = 0
                for i, at, n in s:
                    rows.append((names[i], at, n, crc32_of(wide[i][at:at + n]), len(held[i]), next_id, offset))
                    offset += n
                next_id += 1
            return batch(PIECES, list(zip(*rows)))

        for name, x in each_row(batches):
            names.append(name)
            held.append(np.frombuffer(x, kind))
            tokens += len(held[-1])
            if len(held) >= shard_docs or tokens >= shard_tokens:
                yield shard()
                held, names, tokens = [], [], 0
        if held:
            yield shard()

    return dealt.mapInArrow(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
