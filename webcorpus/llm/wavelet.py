"""A wavelet matrix: a token sequence as bit-planes that answer access, rank, select and counts."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the file format: mark, and bits between two stored ranks.
MAGIC, STEP = b"WVM1", 4096


class Plane:
    """Bits with a rank sample every ``STEP`` bits."""

    def __init__(self, packed: np.ndarray, n: int, samples: np.ndarray):
        self.packed, self.n, self.samples = packed, n, samples
        self.zeros = n - int(samples[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits)
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), STEP // 8), dtype=np.int64) if len(packed) else []
        return cls(packed, len(bits), np.concatenate(([0], np.cumsum(ones))).astype("<u4"))

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, i: int, value: int = 1) -> int:
        """How many of the first ``i`` bits equal ``value``."""
        block = i // STEP
        ones = int(self.samples[block]) + int(np.bitwise_count(self.packed[block * STEP >> 3:i >> 3]).sum())
        if i & 7:
            ones += (int(self.packed[i >> 3]) >> (8 - (i & 7))).bit_count()
        return ones if value else i - ones

    def select(self, k: int, value: int) -> int:
        """Position of the ``k``-th (from 0) bit that equals ``value``."""
        before = self.samples.astype(np.int64) if value else np.minimum(np.arange(len(self.samples), dtype=np.int64) * STEP, self.n) - self.samples
        block = int(np.searchsorted(before, k, side="right")) - 1
        lo = block * STEP
        bits = np.unpackbits(self.packed[lo >> 3:(lo + STEP) >> 3])[:self.n - lo]
        return lo + int(np.flatnonzero(bits == value)[k - int(before[block])])


class WaveletMatrix:
    """Tokens of one shard. ``alphabet`` lists the ids that occur, the most frequent first; planes hold their ranks in it,
    highest bit first, so that the high planes are almost empty."""

    def __init__(self, n: int, alphabet: np.ndarray, planes: list[Plane]):
        self.n, self.alphabet, self.planes = n, alphabet, planes
        self.rank_of: dict[int, int] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        counts = np.bincount(ids)
        alphabet = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)].astype("<u4")
        code = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        now = code[ids]
        planes = []
        for p in reversed(range(cls.width(alphabet))):
            ones = (now & (1 << p)) != 0
            planes.append(Plane.of(ones))
            now = np.concatenate((now[~ones], now[ones]))
        return cls(len(ids), alphabet, planes)

    @staticmethod
    def width(alphabet: np.ndarray) -> int:
        return max(0, len(alphabet) - 1).bit_length()

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        now = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for p, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane.packed, count=self.n).view(bool)
            was = np.empty_like(now)
            was[~ones] = now[:plane.zeros]
            was[ones] = now[plane.zeros:] | now.dtype.type(1 << p)
            now = was
        return self.alphabet[now]

    def code(self, token: int) -> int | None:
        if self.rank_of is None:
            self.rank_of = {t: i for i, t in enumerate(self.alphabet.tolist())}
        return self.rank_of.get(token)

    def access(self, i: int) -> int:
        code = 0
        for plane in self.planes:
            b = plane.bit(i)
            i = plane.rank(i, b) + (plane.zeros if b else 0)
            code = code << 1 | b
        return int(self.alphabet[code])

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        for p, plane in zip(reversed(range(len(self.planes))), self.planes):
            b = code >> p & 1
            lo, hi = (plane.rank(x, b) + (plane.zeros if b else 0) for x in (lo, hi))
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences in positions ``lo`` to ``hi`` (excluded)."""
        code = self.code(token)
        if code is None or not self.n:
            return 0
        a, b = self._range(code, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        code = self.code(token)
        at = self._range(code, 0, self.n)[0] + k
        for p, plane in enumerate(reversed(self.planes)):
            b = code >> p & 1
            at = plane.select(at - plane.zeros if b else at, b)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def dump(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """One compressed file: fixed head, then a zstd frame each for documents, alphabet and every plane.

    The head lists the frames' sizes, so a reader can fetch single planes.
    """
    import zstandard

    m, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], "u1").tobytes() + starts.astype("<i8").tobytes()
    frames = [pack(docs), pack(m.alphabet.tobytes()), *(pack(p.samples.tobytes() + p.packed.tobytes()) for p in m.planes)]
    head = struct.pack("<4sQQQH", MAGIC, m.n, len(doc_ids), len(m.alphabet), len(m.planes))
    return head + struct.pack(f"<{len(frames)}Q", *map(len, frames)) + b"".join(frames)


def load(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, the document ids and where each document starts."""
    import zstandard

    fixed = struct.calcsize("<4sQQQH")
    magic, n, n_docs, _, n_planes = struct.unpack_from("<4sQQQH", data)
    if magic != MAGIC:
        raise ValueError("not a wavelet file")
    sizes = struct.unpack_from(f"<{n_planes + 2}Q", data, fixed)
    at, frames, unpack = fixed + 8 * len(sizes), [], zstandard.ZstdDecompressor()
    for s in sizes:
        frames.append(unpack.decompress(data[at:at + s]))
        at += s
    ids, null = np.frombuffer(frames[0], "<i8", n_docs), np.frombuffer(frames[0], "u1", n_docs, 8 * n_docs)
    docs = [None if x else int(i) for i, x in zip(ids, null)]
    starts = np.frombuffer(frames[0], "<i8", n_docs, 9 * n_docs)
    k = 4 * (-(-n // STEP) + 1)
    planes = [Plane(np.frombuffer(f, np.uint8, offset=k), n, np.frombuffer(f, "<u4", k // 4)) for f in frames[2:]]
    return WaveletMatrix(n, np.frombuffer(frames[1], "<u4"), planes), docs, starts
