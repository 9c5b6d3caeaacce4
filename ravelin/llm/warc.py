"""WARC archives with a two-level capture index.

Writing: one record per page, each its own gzip member, appended to archive
files in a shared folder.  A payload of at least ``LEAST_BYTES`` that several
pages share is stored once, with the smallest page id; the others are revisit
records that name it and hold no payload.

Index: captures are sorted by reversed-host url key and page id
(``com,example,blog)/path?query 42``).  Runs of ``BLOCK_ENTRIES`` index lines
are compressed into blocks; each index part ends in a sparse directory with the
first key and byte range of its blocks.  The list of parts is bounded by
``MOST_PARTS``.  A lookup binary-searches parts, directory and block, and then
reads the capture's byte range from its archive.

Files are written by executors through pyarrow's file systems to a folder that
all of them share.  Names are unique to an attempt and only files named by a
finished task are used, so a task that is run again does no harm.

Defined results: null html is an empty payload; payloads under LEAST_BYTES are
always responses; rows repeated under the smallest id are all responses; a null
page id never is the smallest and is given back as null; a null url has the
empty key; an empty table gives an empty result and no archive.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import payload, tune, work_path, written
from .url_reputation import host_and_path

LEAST_BYTES = 100
BLOCK_ENTRIES, PART_ENTRIES, MOST_PARTS = 2_000, 40_000, 4_096
ARCHIVE_BYTES = 256 << 20
#: So many shared payloads (a digest and an id each) are broadcast at most.
BROADCAST_ROWS = 200_000
_ID = "urn:page:"
_TAIL = ">QQ"
CAPTURE = [("key", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("size", pa.int64())]
PART = [("first", pa.binary()), *CAPTURE[1:]]


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as they are: Arrow keeps integers whole beside nulls."""
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def batch_of(rows: list, columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(columns)], [name for name, _ in columns])


def store(uri: str):
    """(file system, path) of a folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def capture_key(url: Column, page_id: Column) -> Column:
    """Sort key of a capture: reversed host, path and query, page id padded to sort as a number."""
    url = F.coalesce(url, F.lit(""))
    host, _ = host_and_path(url)
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substring(url, at + 3 + F.length(host), F.length(url)), "^[^#]*", 0)
    key = F.when(at > 0, F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)).otherwise(url)
    number = F.when(page_id.isNull(), "-").when(page_id < 0, F.concat(F.lit("-"), F.lpad(F.substring(page_id.cast("string"), 2, 20), 20, "0"))).otherwise(F.lpad(page_id.cast("string"), 20, "0"))
    return F.concat(F.regexp_replace(key, "[\\s\\x00]", "%20"), F.lit(" "), number)


def record(page_id: int | None, url: str | None, body: bytes | None, size: int, digest: str, refers_to: int | None, place: str) -> bytes:
    """One WARC record; without a body it is a revisit of ``refers_to``.  ``place`` makes the record's id unique."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "" if url is None else "WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c <= " " else c for c in url) + "\r\n"
    revisit = "" if body is not None else f"WARC-Refers-To: <{_ID}{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    block = http + (body or b"")
    head = f"WARC/1.1\r\nWARC-Type: {'revisit' if body is None else 'response'}\r\nWARC-Record-ID: <{_ID}{'' if page_id is None else page_id}:{place}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n{target}{revisit}WARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of one record as read: the payload's size and digest are taken from it, a revisit's from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if (x := x[1:-1].removeprefix(_ID).partition(":")[0]) else None
    out = {"page_id": number(named["WARC-Record-ID"]), "url": named.get("WARC-Target-URI"), "record_type": named["WARC-Type"], "refers_to": None, "payload": body}
    if out["record_type"] == "revisit":
        size = next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
        return out | {"refers_to": number(named["WARC-Refers-To"]), "payload": None, "payload_bytes": int(size[16:]), "payload_digest": named["WARC-Payload-Digest"].removeprefix("sha256:")}
    return out | {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}


def _pack(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives; returns the captures: ``key, file, start, size``."""
    tune(pages.sparkSession)
    body = payload(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    shared = rows.where(F.col("size") >= LEAST_BYTES).select("digest", "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    # Few payloads are shared as a rule; then pages need no exchange.  Else they meet the table by their digest.
    shared = written(shared, "shared")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    rows = rows.join(shared, "digest", "left").select("page_id", "url", capture_key(F.col("url"), F.col("page_id")).alias("key"), F.when(~revisit, F.col("body")).alias("body"), "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        out = name = None
        try:
            for batch in batches:
                done = []
                for page, url, key, text, size, digest, first in rows_of(batch):
                    if out is None:
                        files.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    packed = _pack(record(page, url, text, size, digest, first, f"{name}:{at}"))
                    out.write(packed)
                    done.append((key, name, at, len(packed)))
                    at += len(packed)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                yield batch_of(done, CAPTURE)
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, "key string, file string, start long, size long"), "captures")


def build_index(captures: DataFrame, folder: str) -> list[tuple[bytes, str, int, int]]:
    """Sort captures into compressed blocks with a directory; returns the parts: (first key, file, start and size of the directory)."""
    parts = min(MOST_PARTS, max(1, -(-captures.count() // PART_ENTRIES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        lines: list[bytes] = []
        directory: list[bytes] = []
        first = out = None
        at = 0

        def close_block() -> None:
            nonlocal at
            block = zlib.compress(b"\n".join(lines), 6)
            directory.append(b"\t".join([lines[0].split(b"\t", 1)[0], b"%d" % at, b"%d" % len(block)]))
            out.write(block)
            at += len(block)
            lines.clear()

        for batch in batches:
            for key, file, start, size in rows_of(batch):
                if out is None:
                    files.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.idx"
                    out, first = files.open_output_stream(f"{path}/{name}", compression=None), key
                lines.append(b"\t".join([key.encode(), file.encode(), b"%d" % start, b"%d" % size]))
                if len(lines) >= BLOCK_ENTRIES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            packed = zlib.compress(b"\n".join(directory), 6)
            out.write(packed + struct.pack(_TAIL, at, len(packed)))
            out.close()
            yield batch_of([(first.encode(), name, at, len(packed))], PART)

    made = captures.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(run, "first binary, file string, start long, size long")
    return sorted((bytes(r["first"]), r["file"], r["start"], r["size"]) for r in made.collect())


class Reader:
    """Looks captures up by key through the index."""

    def __init__(self, folder: str, parts: list[tuple[bytes, str, int, int]]):
        self.files, self.path = store(folder)
        self.parts, self.firsts = parts, [p[0] for p in parts]
        self.open: dict[str, object] = {}
        self.part = self.block = -1

    def read(self, file: str, start: int, size: int) -> bytes:
        f = self.open.pop(file, None) or self.files.open_input_file(f"{self.path}/{file}")
        self.open[file] = f  # the most recent last
        if len(self.open) > 32:
            self.open.pop(next(iter(self.open))).close()
        f.seek(start)
        return f.read(size)

    def load_part(self, i: int) -> None:
        if i != self.part:
            _, file, start, size = self.parts[i]
            self.directory = [(k, int(s), int(n)) for k, s, n in (x.split(b"\t") for x in zlib.decompress(self.read(file, start, size)).split(b"\n"))]
            self.heads = [d[0] for d in self.directory]
            self.part, self.block = i, -1

    def load_block(self, j: int) -> None:
        if j != self.block:
            _, start, size = self.directory[j]
            self.lines = [x.split(b"\t") for x in zlib.decompress(self.read(self.parts[self.part][1], start, size)).split(b"\n")]
            self.keys = [x[0] for x in self.lines]
            self.block = j

    def find(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """Byte ranges of all captures with this key."""
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.parts) and self.firsts[i] <= key:
            self.load_part(i)
            j = max(0, bisect.bisect_left(self.heads, key) - 1)
            while j < len(self.directory) and self.heads[j] <= key:
                self.load_block(j)
                at = bisect.bisect_left(self.keys, key)
                while at < len(self.lines) and self.keys[at] == key:
                    yield self.lines[at][1].decode(), int(self.lines[at][2]), int(self.lines[at][3])
                    at += 1
                j += 1
            i += 1


RECORD = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
FIELDS = list(RECORD)


def lookup(keys: DataFrame, folder: str, parts: list[tuple[bytes, str, int, int]], with_payload: bool = True) -> DataFrame:
    """Records of the captures whose key is among the distinct ``keys`` (column ``key``)."""
    fields = FIELDS if with_payload else FIELDS[:-1]
    shape = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    shared = keys.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, shared.value)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for file, start, size in reader.find(key.encode()):
                    got = parsed(zlib.decompress(reader.read(file, start, size), 31))
                    rows.append([got[k] for k in fields])
            yield batch_of(rows, [(k, RECORD[k]) for k in fields])

    n = max(1, len(parts))
    return keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(run, shape)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Archive and index ``pages``, then read every page's record back through the index."""
    folder = work_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, id_col, url_col, html_col)
    parts = build_index(captures, folder)
    return lookup(captures, folder, parts, with_payload)
