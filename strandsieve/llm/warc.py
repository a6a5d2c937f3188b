"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress independently. A skippable frame after them maps each record's id to its
frame and its offset in the decompressed frame, and a last one holds the seek table of the Zstandard seekable format:
sizes of all frames. Any zstd tool decompresses a bundle to a plain WARC file; a reader with the tables decompresses
the one frame it wants.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_last, pa_schema, scratch, small_batches, staged
from .files import reading, writing

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, and in a bundle, after which the next begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record with the payload, or a revisit record that keeps its HTTP head and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block, and where the record ends."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    start, size = end + 4, int(head["content-length"])
    return head, raw[start : start + size], start + size + 4


class BundleWriter:
    """Adds records to a stream; finish() writes the record index and the seek table."""

    def __init__(self, out):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.held, self.size, self.frames, self.index, self.raw, self.records = [], 0, [], [], 0, 0

    def add(self, record_id: str, raw: bytes) -> None:
        self.index.append((record_id, len(self.frames), self.size, len(raw)))
        self.held.append(raw)
        self.size += len(raw)
        self.raw += len(raw)
        self.records += 1
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def finish(self) -> None:
        self._flush()
        body = self.pack.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        # the index is a frame without content in the seek table
        frames = [*self.frames, (len(body) + 8, 0)]
        table = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class BundleReader:
    """Frames and records of a bundle by its footer."""

    def __init__(self, f):
        self.f, size = f, f.size()
        f.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        f.seek(size - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", f.read(8 * n)))
        self.at, place = [], 0
        for packed, _ in sizes:
            self.at.append(place)
            place += packed
        self.sizes, self.unpack = sizes, zstandard.ZstdDecompressor()
        f.seek(self.at[-1])
        self.index = [tuple(x) for x in json.loads(self.unpack.decompress(f.read(sizes[-1][0])[8:]))]
        self.places = {record_id: (k, at) for record_id, k, at, _ in self.index}

    def frame(self, k: int) -> bytes:
        self.f.seek(self.at[k])
        return self.unpack.decompress(self.f.read(self.sizes[k][0]), max_output_size=self.sizes[k][1])

    def record(self, record_id: str) -> tuple[dict[str, str], bytes]:
        """Random access: only the record's frame is read."""
        k, at = self.places[record_id]
        return parse_record(self.frame(k), at)[:2]

    def records(self) -> Iterator[tuple[str, dict[str, str], bytes]]:
        last, raw = None, b""
        for record_id, k, at, _ in self.index:
            if k != last:
                last, raw = k, self.frame(k)
            yield (record_id, *parse_record(raw, at)[:2])


def record_id(page_id: int | None, row: int) -> str:
    """A record's id: the page's id, and the row's number, which no two records share."""
    return f"urn:page:{'none' if page_id is None else page_id}:{row}"


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, row, refers_to, refers_row): of pages with equal payloads of at least least bytes the one with
    the smallest page_id stays (refers_to null), the others refer to it. A page without an id is larger than all others.

    Pages are written with their row numbers first, so that these stay the same however often pages are read.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "warc-pages", "zstd")
    narrow = rows.filter(F.octet_length("html") >= least).select("row", id_or_last("page_id").alias("p"), F.unhex(F.sha2("html", 256)).alias("sha"))
    low = narrow.groupBy("sha").agg(F.min(F.struct("p", "row")).alias("low"), F.max("p").alias("high")).filter("low.p < high").select("sha", "low")
    # written first, so that Spark can split the rows of one very common payload
    refers = narrow.join(staged(low, "warc-lowest"), "sha").filter("p > low.p").select("row", F.col("low.p").alias("refers_to"), F.col("low.row").alias("refers_row"))
    return rows.join(refers, "row", "left").select("page_id", "url", "html", "row", "refers_to", "refers_row")


def write_bundles(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for each page into bundles of folder; the manifest has file, n_records and raw_bytes."""
    small_batches(pages.sparkSession, 512)
    schema = "file string, n_records long, raw_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        task, k, row = TaskContext.get().partitionId(), 0, next(rows, None)
        while row is not None:
            name = f"{folder}/pages-{task:06d}-{k:04d}.warc.zst"
            with writing(name) as out:
                w = BundleWriter(out)
                while row is not None and w.raw < BUNDLE_BYTES:
                    page_id, url, html, number, refers_to, refers_row = row
                    own = record_id(page_id, number)
                    # a line break can't stand in a header
                    w.add(own, record(own, " ".join((url or "").split()), html.encode(), None if refers_to is None else record_id(refers_to, refers_row)))
                    row = next(rows, None)
                w.finish()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [w.records], "raw_bytes": [w.raw]}, schema=pa_schema(schema))
            k += 1

    return staged(with_revisits(pages, least).mapInArrow(run, schema), "warc-manifest")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(manifest: DataFrame) -> DataFrame:
    """A row for each record of the bundles."""
    n = max(1, manifest.count())

    def number(urn: str | None) -> int | None:
        page_id = (urn or "::none").strip("<>").split(":")[2]
        return None if page_id == "none" else int(page_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                with reading(name) as f:
                    out = []
                    for _, head, block in BundleReader(f).records():
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{name}: {head['warc-record-id']} doesn't have its payload")
                        out.append((number(head["warc-record-id"]), size, digest, head["warc-type"], number(head.get("warc-refers-to"))))
                    for i in range(0, len(out), 8192):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 8192], strict=True), pa_schema(_READ).types, strict=True)], schema=pa_schema(_READ))

    return manifest.select("file").repartition(n).mapInArrow(run, _READ)


def warc_roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as WARC bundles in the shared folder and return what is read from them.

    One row per page: page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to. A null html counts
    as empty. Pages without a page_id have records too, and never stand for others with one; rows that repeat the
    smallest page_id of a payload are all responses. An empty table writes no bundle and gives no row.
    """
    return read_bundles(write_bundles(pages, scratch(pages.sparkSession, "warc"), least))
