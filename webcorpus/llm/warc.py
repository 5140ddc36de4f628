"""WARC records in seekable Zstandard bundles: independent frames, a seek table behind them, an index of records."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import batch, each_row, new_folder, read_file, write_file

#: Fixed values of the public seekable Zstandard format, and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def record_id(page_id: int | None, part: int, number: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>" if page_id is not None else f"<urn:page:null:{part}:{number}>"


def build_record(ident: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit carries the response's head but no payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + CRLF + CRLF
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'null' if page_id is None else page_id}", f"Content-Length: {len(http) + len(body)}",
    ]
    if revisit:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 0, 0)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + http + body + CRLF + CRLF


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Header fields, HTTP fields and payload of the records in a frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        block = data[stop + 4:stop + 4 + int(fields["Content-Length"])]
        cut = block.index(b"\r\n\r\n")
        http = dict(line.split(": ", 1) for line in block[:cut].decode().split("\r\n")[1:])
        yield fields, http, block[cut + 4:]
        at = stop + 4 + len(block) + 4


class Bundle:
    """Collects records into frames of about ``frame_bytes``."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.pack, self.frame_bytes, self.frames, self.sizes, self.now, self.packed = zstandard.ZstdCompressor(level=level).compress, frame_bytes, [], [], bytearray(), 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in the frame's content, and length of the record."""
        place = len(self.frames), len(self.now), len(record)
        self.now += record
        if len(self.now) >= self.frame_bytes:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.now:
            self.frames.append(self.pack(bytes(self.now)))
            self.sizes.append((len(self.frames[-1]), len(self.now)))
            self.packed += len(self.frames[-1])
            self.now = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Compressed and full sizes of the frames, from a file's end."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    return list(struct.iter_unpack("<II", tail[-9 - 8 * n:-9]))


def read_record(path: str, frame: int, offset: int, length: int) -> bytes:
    """One record: reads the seek table and the one frame that holds it."""
    import zstandard
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        size = f.size()
        f.seek(size - 9)
        n = struct.unpack("<I", f.read(4))[0]
        f.seek(size - 9 - 8 * n)
        sizes = seek_table(f.read())
        f.seek(sum(s for s, _ in sizes[:frame]))
        return zstandard.ZstdDecompressor().decompress(f.read(sizes[frame][0]))[offset:offset + length]


INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def write_bundles(pages: DataFrame, folder: str, least: int = 1000, frame_bytes: int = 1 << 20, file_bytes: int = 128 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns the index of records: identifier, file, frame, place in the frame.

    Only digests of several rows are looked up. That table is stored, so that Spark broadcasts it while it
    is small; beyond, pages are joined by digest and AQE splits a payload that a third of the pages share.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
    digest, size = F.sha1("payload"), F.length("payload").cast("long")
    many = rows.where(size >= least).groupBy(digest.alias("_digest")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("_digest", "last")
    keyed = rows.select("*", digest.alias("digest"), size.alias("size"))
    decided = keyed.join(cut_lineage(many), F.col("digest") == F.col("_digest"), "left").select("page_id", "url", "payload", "digest", "size", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files, held, bundle, count = TaskContext.get().partitionId(), 0, [], Bundle(frame_bytes, level), 0

        def close() -> pa.RecordBatch:
            nonlocal files, held, bundle
            path = f"{folder}/part-{part:06d}-{files:05d}.warc.zst"
            write_file(path, bundle.finish())
            files, rows, held, bundle = files + 1, held, [], Bundle(frame_bytes, level)
            return batch(INDEX, [[r[0] for r in rows], [r[1] for r in rows], [path] * len(rows), *([r[i] for r in rows] for i in (2, 3, 4))])

        for page_id, url, payload, dig, n, refers in each_row(batches):
            ident = record_id(page_id, part, count)
            count += 1
            held.append((ident, page_id, *bundle.add(build_record(ident, page_id, url, payload, dig, n, refers, date))))
            if bundle.packed >= file_bytes:
                yield close()
        if held:
            yield close()

    return cut_lineage(decided.mapInArrow(write, "record_id string, page_id long, path string, frame long, offset long, length long"))


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the indexed files: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's size and digest are computed from its payload; a revisit's come from its head.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for path in b.column(0).to_pylist():
                data, at = read_file(path), 0
                for packed, _ in seek_table(data):
                    rows = []
                    for f, http, payload in parse_records(unpack(data[at:at + packed])):
                        page = None if f["X-Page-ID"] == "null" else int(f["X-Page-ID"])
                        if f["WARC-Type"] == "revisit":
                            rows.append((page, int(http["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(f["WARC-Refers-To"][len("<urn:page:"):-1])))
                        else:
                            rows.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                    at += packed
                    yield batch(ROWS, list(zip(*rows)))

    files = index.select("path").distinct()
    return files.repartition("path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages as bundles, read the bundles back.

    Null html is an empty payload; equal rows each have a record, and copies of the page that is the response are all
    responses; rows without page_id are never referred to, and revisit an equal page that has one; an empty table writes nothing.
    """
    return read_bundles(write_bundles(pages, new_folder(pages.sparkSession, "warc"), **options))
