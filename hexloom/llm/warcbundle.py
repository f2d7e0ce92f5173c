"""WARC records in seekable Zstandard bundles (operator 7).

A bundle is a sequence of independent Zstandard frames, each holding whole records, and a last, skippable frame
with the seek table (compressed and decompressed size of each frame, in the public seekable format). An index maps
each record identifier to its bundle, frame and the offset inside the decompressed frame, so that one record is
read by fetching and decompressing one frame.

Bundles are rows (bundle_id, data, index) of a table in shared storage: any file system that the engine can write
to will do, and a lost executor loses nothing. export_bundles() writes them as files with their index beside them, from
which read_exported() fetches one record.

Of records with equal payloads of `min_revisit` bytes or more, that of the smallest page_id is the response; the
others are revisits, which refer to it and carry no payload.

Defined results: a null html is an empty payload; repeated rows of the smallest page_id are all responses, of other
page_ids all revisits; null page_ids never are responses for others; an empty table gives no records; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.llm.arrow import batch, map_arrow
from hexloom.session import stage

MIN_REVISIT = 100
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 4 * 1024 * 1024
LEVEL = 3
#: Fixed values of the public seekable format: a skippable frame, and the magic number that ends the footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
BUNDLE_SCHEMA = "bundle_id string, data binary, index array<struct<record_id:string,page_id:long,frame:int,offset:long,length:long>>"
_DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6f1c1f0a-5d0b-4a57-9d0e-0d1f3a1c7e11")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to given) has no block."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    clean = "".join((url or "").split())
    if clean:
        head.append(f"WARC-Target-URI: {clean}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    block = payload if refers_to is None else b""
    head += [f"X-Payload-Length: {len(payload)}", *([f"X-Page: {page_id}"] if page_id is not None else []), "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record begins at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end where it says")
    return headers, data[begin:end], end + 4


class BundleWriter:
    def __init__(self, level: int = LEVEL):
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.open_size, self.size = [], 0, 0
        self.index: list[dict] = []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.index.append({"record_id": record_id(page_id), "page_id": page_id, "frame": len(self.frames), "offset": self.open_size, "length": len(record)})
        self.open.append(record)
        self.open_size += len(record)
        if self.open_size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def close(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, read from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    begin = len(data) - 9 - 8 * n
    if magic != SEEKABLE_MAGIC or struct.unpack("<II", data[begin - 8 : begin]) != (SKIPPABLE_MAGIC, 8 * n + 9):
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for k in range(n):
        c, d = struct.unpack_from("<II", data, begin + 8 * k)
        out.append((at, c, d))
        at += c
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, c, d = frame
    return zstandard.ZstdDecompressor().decompress(data[at : at + c], max_output_size=d)


def read_record(data: bytes, entry: dict) -> tuple[dict[str, str], bytes]:
    """One record, by its index entry: one frame is decompressed."""
    headers, block, _ = parse_record(read_frame(data, seek_table(data)[entry["frame"]]), entry["offset"])
    return headers, block


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = None

    def done(w: BundleWriter) -> pa.RecordBatch:
        data = w.close()
        return batch(["bundle_id", "data", "index"], [[hashlib.sha256(data).hexdigest()[:32]], [data], [w.index]], [pa.string(), pa.binary(), pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))])

    for b in batches:
        for page_id, url, payload, digest, refers_to in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "refers_to"))):
            writer = writer or BundleWriter()
            writer.add(page_id, warc_record(page_id, url, payload, digest, refers_to))
            if writer.size >= BUNDLE_BYTES:
                yield done(writer)
                writer = None
    if writer:
        yield done(writer)


def write_bundles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The bundles of all pages: bundle_id, data, index; written to shared storage."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # minima of map-side aggregation; the pages are joined with digests that occur twice, of which there are few
    first = df.filter(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    df = df.join(stage(first), "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    return stage(map_arrow(df.select("page_id", "url", "payload", "digest", "refers_to"), _bundles, BUNDLE_SCHEMA))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data, index in zip(b.column("data").to_pylist(), b.column("index").to_pylist()):
            rows, frames, k, text = [], seek_table(data), -1, b""
            for e in index:
                if e["frame"] != k:
                    k = e["frame"]
                    text = read_frame(data, frames[k])
                headers, block, end = parse_record(text, e["offset"])
                if headers["WARC-Record-ID"] != e["record_id"] or end - e["offset"] != e["length"]:
                    raise ValueError(f"the index is wrong for {e['record_id']}")
                stated, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                if kind == "response" and hashlib.sha256(block).hexdigest() != stated:
                    raise ValueError(f"the payload of {e['record_id']} is not what was written")
                refers = headers.get("X-Refers-To-Page")
                rows.append((int(headers["X-Page"]) if "X-Page" in headers else None, len(block) if kind == "response" else int(headers["X-Payload-Length"]), stated, kind, None if refers is None else int(refers)))
            yield batch(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], list(zip(*rows)), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, checked against the index."""
    return map_arrow(bundles.select("data", "index"), _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI (or path), and the folder's path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else Path(uri).absolute().as_uri())


def export_bundles(bundles: DataFrame, folder: str) -> int:
    """Write bundles as files <bundle_id>.warc.zst, and their index as a table `index`, into a folder; the number of
    files. The folder is a URI that pyarrow and the engine both reach (object stores, HDFS), or one that all mount."""

    def write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        for b in batches:
            names = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(part) as f:
                    f.write(data.as_buffer())
                files.move(part, f"{base}/{name}.warc.zst")  # a task that runs again writes the same
                names.append(name)
            yield batch(["name"], [names], [pa.string()])

    n = map_arrow(bundles.select("bundle_id", "data"), partial(write, folder=folder), "name string").distinct().count()
    uri = folder if "://" in folder or folder.startswith("file:") else Path(folder).absolute().as_uri()
    bundles.select("bundle_id", F.explode("index").alias("e")).select("bundle_id", "e.*").write.mode("overwrite").parquet(f"{uri}/index")
    return n


def read_exported(folder: str, entry: dict) -> tuple[dict[str, str], bytes]:
    """One record of an exported bundle, by its row of the index: the footer and one frame are read, and no more."""
    files, base = _files(folder)
    with files.open_input_file(f"{base}/{entry['bundle_id']}.warc.zst") as f:
        size = f.size()
        f.seek(size - 9)
        (n, _, magic) = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC or size < 17 + 8 * n:
            raise ValueError("not a seekable bundle")
        f.seek(size - 17 - 8 * n)
        at, c, d = seek_table(f.read(17 + 8 * n))[entry["frame"]]
        f.seek(at)
        headers, block, _ = parse_record(read_frame(f.read(c), (0, c, d)), entry["offset"])
    return headers, block
