"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, frames into bundle files of bounded size; a seek table in a
skippable frame at the end of the file holds each frame's compressed and plain length (the public seekable format), and
an index maps each record id to bundle, frame and offset in the frame. Reading seeks to single frames.

Bundles are written by tasks under names of their own and moved into place when complete; the index of a bundle comes
from the task that succeeded, so lost executors and repeated tasks leave nothing but an unreferenced file.

Defined results: a null payload is empty; records of equal payloads of at least `revisit_from` bytes revisit the one with
the smallest id, which is a response; smaller ones are all responses; the payload of a revisit is not stored again. A
record is known by id and payload together: rows that repeat both have a record each, all as the first one is; rows that
repeat an id with other payloads are judged apart. A null id is a response and revisited by none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlake.llm.common import shared_dir

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 128 << 10  #: plain bytes of a frame, from which the next begins
BUNDLE_BYTES = 64 << 20  #: compressed bytes of a bundle, likewise
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset int, length int"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; with refers_to a revisit without payload."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of the record at the start of data."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    return headers, rest[:n]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """Start, compressed and plain length of each frame of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """A bundle that is being written."""

    def __init__(self, root: str):
        self.store, self.folder = fs.FileSystem.from_uri(root)
        self.store.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(f"{self.folder}/.{self.name}.part")
        self.frames, self.held, self.size, self.index, self.written = [], [], 0, [], 0
        self.packer = zstandard.ZstdCompressor(level=6, write_content_size=True)

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((page_id, self.name, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> list[tuple]:
        self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.store.move(f"{self.folder}/.{self.name}.part", f"{self.folder}/{self.name}")
        return self.index


def writer(root: str):
    """Function for mapInArrow: rows (page_id, url, html, refers_to) go into bundles below root, their index comes out."""

    def entries(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "bundle", "frame", "offset", "length"])

    def run(batches: Iterator[pa.RecordBatch]):
        bundle = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, refers_to = row
                bundle = bundle or Bundle(root)
                bundle.add(page_id, record(page_id, url, (html or "").encode(), refers_to))
                if bundle.written >= BUNDLE_BYTES:
                    yield entries(bundle.close())
                    bundle = None
        if bundle:
            yield entries(bundle.close())

    return run


def reader(root: str):
    """Function for mapInArrow: rows of the index, a bundle's rows together and in order, become the records they point to."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, folder = fs.FileSystem.from_uri(root)
        source = name = frames = held = None
        plain, unpack = b"", zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for page_id, bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    source, name, held = store.open_input_file(f"{folder}/{bundle}"), bundle, None
                    frames = read_seek_table(source)
                if frame != held:
                    at, packed, size = frames[frame]
                    source.seek(at)
                    plain, held = unpack.decompress(source.read(packed), max_output_size=size), frame
                headers, body = parse(plain[offset : offset + length])
                refers = headers.get("WARC-Refers-To")
                named = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                if named != ("" if page_id is None else str(page_id)) or (refers is None and headers["WARC-Payload-Digest"] != f"sha1:{digest(body)}"):
                    raise ValueError(f"record {page_id} of {bundle} is not what the index says")
                out.append((page_id, headers["WARC-Target-URI"], int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"][5:], headers["WARC-Type"], int(refers[len("<urn:page:") : -1]) if refers else None, body if refers is None else None))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], RECORDS)

    return run


RECORDS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
RECORDS_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payload_hash() -> Column:
    return F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))


def originals(pages: DataFrame, revisit_from: int) -> DataFrame:
    """own, payload, original: for ids with a payload that also comes under a smaller id, that smallest id."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    slim = pages.where(F.col("page_id").isNotNull() & (size >= revisit_from)).select(F.col("page_id").alias("own"), payload_hash().alias("payload"))
    first = slim.groupBy("payload").agg(F.min("own").alias("original"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    return slim.join(first, "payload").where("own <> original").distinct()


def write(pages: DataFrame, root: str, revisit_from: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) below root; the index of what was written. Nothing is written before it is read."""
    rows = pages.select("page_id", "url", "html", payload_hash().alias("_payload"))
    rows = rows.join(originals(pages, revisit_from), (F.col("page_id") == F.col("own")) & (F.col("_payload") == F.col("payload")), "left")
    return rows.select("page_id", "url", "html", F.col("original").alias("refers_to")).mapInArrow(writer(root), INDEX)


def read(index: DataFrame, root: str) -> DataFrame:
    """The records to which an index points; a revisit's payload is null."""
    return index.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(reader(root), RECORDS_SCHEMA)


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write an archive of pages in the shared folder and read it back."""
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    index = write(pages, f"{root}/bundles", revisit_from)
    index.write.parquet(f"{root}/index")
    return read(spark.read.schema(INDEX).parquet(f"{root}/index"), f"{root}/bundles")
