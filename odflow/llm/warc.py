"""WARC archives as bundles of independent Zstandard frames with a seek table.

A bundle is a file of frames that each decompress on their own, closed by a
skippable frame in the public "Zstandard seekable format": for each frame its
compressed and decompressed size, then the frame count and a magic number. The
index maps a record to its bundle, frame and place in the decompressed frame,
so a reader fetches the table and one frame, never the whole file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id long, bundle string, frame int, frame_begin long, record_begin long, record_length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that has only the HTTP header."""
    name = lambda i: f"<urn:page:{i}>"
    target = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, body = ("response", http + payload) if refers_to is None else ("revisit", http)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return ("\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record's headers in lower case, its HTTP headers under "http", its payload under "payload"."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda h: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in h.decode().split("\r\n")[1:])}
    out = fields(head)
    body = rest[: int(out["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record has no end mark")
    http, _, payload = body.partition(b"\r\n\r\n")
    return out | {"http": fields(http), "payload": payload}


class Bundle:
    """A file under construction: frames of at least frame_bytes, each compressed on its own."""

    def __init__(self, path: str, frame_bytes: int, level: int):
        self.path, self.frame_bytes, self.zstd = path, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.fs, self.place = file_system(path)
        self.out = self.fs.open_output_stream(self.place + ".part")
        self.sizes: list[tuple[int, int]] = []
        self.written, self.pending, self.pending_bytes, self.rows = 0, [], 0, []
        self.add_info()

    def add_info(self) -> None:
        body = b"format: WARC File Format 1.1\r\n"
        self.pending = [f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"]
        self.flush()

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.rows.append((page_id, self.path, len(self.sizes), self.written, self.pending_bytes, len(raw)))
        self.pending.append(raw)
        self.pending_bytes += len(raw)
        if self.pending_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            plain = b"".join(self.pending)
            frame = self.zstd.compress(plain)
            self.out.write(frame)
            self.sizes.append((len(frame), len(plain)))
            self.written += len(frame)
            self.pending, self.pending_bytes = [], 0

    def close(self) -> list[tuple]:
        """Write the seek table, give the file its name, and return the index rows."""
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.fs.move(self.place + ".part", self.place)
        return self.rows


class Reader:
    """Random access to a bundle through its seek table; keeps the frame read last."""

    def __init__(self, path: str):
        fs, place = file_system(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{path} has no seek table")
        table = struct.iter_unpack("<II", self.file.read_at(8 * count, size - 9 - 8 * count))
        self.begins, self.sizes, at = [], [], 0
        for packed, plain in table:
            self.begins.append(at)
            self.sizes.append((packed, plain))
            at += packed
        self.zstd, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def read(self, frame: int, begin: int, length: int) -> bytes:
        if self.last[0] != frame:
            packed, plain = self.sizes[frame]
            self.last = (frame, self.zstd.decompress(self.file.read_at(packed, self.begins[frame]), max_output_size=plain))
        return self.last[1][begin : begin + length]

    def close(self) -> None:
        self.file.close()


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    names = [x.split()[0] for x in INDEX.split(", ")]

    def rows(bundle: Bundle) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*bundle.close(), strict=True)) or [[]] * 6
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, bundle = TaskContext.get(), 0, None
        for batch in batches:
            ids, urls, first = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for i, url, ref, html in zip(ids, urls, first, batch.column("html"), strict=True):
                if bundle is None:
                    bundle, k = Bundle(f"{folder}/bundle-{at.partitionId():05d}-{k:03d}-{uuid.uuid4().hex[:12]}.warc.zst", frame_bytes, level), k + 1
                raw = html.as_buffer()
                bundle.add(i, record(i, url, raw.to_pybytes() if raw is not None else b"", ref, date))
                if bundle.written >= bundle_bytes:
                    yield rows(bundle)
                    bundle = None
        if bundle:
            yield rows(bundle)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 64 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row and return the index, itself a written table.

    Of rows with equal payloads of at least least_bytes bytes, those with the
    smallest id are responses and the others revisits of it; rows with smaller
    payloads are all responses. A null html is an empty payload; a null id counts
    as larger than all ids; repeated rows are each written. A task that runs twice
    leaves unindexed files, never wrong ones.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    rows = rows.withColumn("label", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    first = cut(rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first")), "first")
    # a page with very many copies is a hot digest: what is joined by it is narrow, pages go by their own id as well
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    revisits = rows.select("label", "page_id", "sha", "size").join(first, ["sha", "size"]).select("label", "sha", refers.alias("refers_to")).where("refers_to is not null").distinct()
    ready = rows.join(cut(revisits, "revisits"), ["label", "sha"], "left").select("page_id", "url", "html", "refers_to")
    return cut(ready.mapInArrow(_writer(folder, frame_bytes, bundle_bytes, level, date), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, path = None, None
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["bundle"] != path:
                if reader:
                    reader.close()
                path, reader = row["bundle"], Reader(row["bundle"])
            found = parse(reader.read(row["frame"], row["record_begin"], row["record_length"]))
            page = found["warc-record-id"][len("<urn:page:") : -1]
            if page != str(row["page_id"]):
                raise ValueError(f"the index leads to page {page} instead of {row['page_id']}")
            digest, kind, ref = found["warc-payload-digest"].removeprefix("sha1:"), found["warc-type"], None
            if kind == "revisit":
                ref = int(found["warc-refers-to"][len("<urn:page:") : -1])
            elif digest32(found["payload"]) != digest:
                raise ValueError(f"page {page} doesn't match its digest")
            out.append((row["page_id"], int(found["http"]["content-length"]), digest, kind, ref, found["warc-target-uri"]))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)], names=names)
    if reader:
        reader.close()


def read_archives(index: DataFrame) -> DataFrame:
    """Read every indexed record through its bundle's seek table; digests of responses are verified."""
    bundles = max(1, index.select("bundle").distinct().count())  # a task a bundle, however few index rows those are
    return index.repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame", "record_begin").mapInArrow(_read, RECORDS)
