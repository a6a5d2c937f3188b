"""Media columns in Matroska: payloads as PCM audio in clusters of laced blocks, and packet tables read from them.

An EBML element is a variable-length id, a variable-length size and its data. The reader walks the elements of a
segment, takes tracks, clusters and cues, splits blocks by their lacing (none, Xiph, fixed or EBML), and gives a packet
table with track, timestamp and byte range; any other element is stepped over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pa_schema, scratch, small_batches

#: Element ids of the Matroska specification.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE = 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Samples (bytes) in a packet; packets a block laces; blocks in a cluster; samples a second.
FRAME, LACED, BLOCKS, RATE = 192, 8, 128, 8000
LACINGS = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    size: int
    cluster: int
    keyframe: bool


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    tracks: dict[int, str]
    scale: int
    clusters: int


def vint(n: int) -> bytes:
    """n as an EBML size of least length."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(id_: int, data: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(id_: int, n: int) -> bytes:
    return element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """Flag bits and the lacing head of a block's frames."""
    if len(frames) == 1 or lacing == "none":
        return 0, b""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = 1
            while abs(b - a) >= 1 << (7 * width - 1):
                width += 1
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return LACINGS[lacing] << 1, head


def mux(payload: bytes, lacing: str = "fixed", frame: int = FRAME) -> bytes:
    """payload as one track of 8-bit PCM in packets of frame bytes, with cues to all clusters."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    audio = element(SAMPLING_FREQUENCY, struct.pack(">f", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    parts = [element(INFO, number(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    each = 1 if lacing == "none" else LACED
    ms = 1000 * frame // RATE
    blocks = max(1, min(BLOCKS, 32000 // max(1, ms * each)))
    for c in range(0, len(payload), frame * each * blocks):
        first = c // frame * ms
        body = [number(TIMESTAMP, first)]
        for b in range(c, min(len(payload), c + frame * each * blocks), frame * each):
            frames = [payload[i : i + frame] for i in range(b, min(len(payload), b + frame * each), frame)]
            flags, lace = laced(frames, lacing)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // frame * ms - first, 0x80 | flags) + lace + b"".join(frames)))
        cues.append(element(CUE_POINT, number(CUE_TIME, first) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def _vint(b: bytes, at: int, marker: bool) -> tuple[int | None, int]:
    """A variable-length number and where it ends; None for the size that says unknown."""
    first = b[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no EBML number at {at}")
    n = int.from_bytes(b[at : at + width], "big")
    if marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return None if n == (1 << 7 * width) - 1 else n, at + width


def elements(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between at and end; one of unknown size goes on to the end of its parent."""
    while at < end:
        id_, a = _vint(b, at, True)
        size, a = _vint(b, a, False)
        stop = end if size is None else min(end, a + size)
        yield id_, a, stop
        at = stop


def _open_end(b: bytes, at: int, stop: int) -> int:
    """Where an element of unknown size ends: at the next element of the level above."""
    while at < stop:
        id_, a = _vint(b, at, True)
        if id_ in (CLUSTER, CUES, TRACKS, INFO):
            return at
        size, a = _vint(b, a, False)
        at = stop if size is None else min(stop, a + size)
    return stop


def _uint(b: bytes, a: int, z: int) -> int:
    return int.from_bytes(b[a:z], "big")


def block_frames(b: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags, and (start, size) of each frame of a block."""
    track, at = _vint(b, at, False)
    rel, flags = struct.unpack_from(">hB", b, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, rel, flags, [(at, end - at)]
    n = b[at] + 1
    at += 1
    if lacing == 2:
        size = (end - at) // n
        return track, rel, flags, [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while b[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + b[at], at + 1
        else:
            width = 9 - b[at].bit_length()
            size, at = _vint(b, at, False)
            size = (size if size is not None else (1 << 7 * width) - 1) + (sizes[-1] - (1 << 7 * width - 1) + 1 if i else 0)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, rel, flags, out


def demux(b: bytes) -> Media:
    """All packets of a file; timestamps count in units of the file's scale, from the block on for each frame it laces."""
    packets, cues, tracks, scale, clusters = [], [], {}, 1_000_000, 0
    todo = [(i, a, z) for i, a, z in elements(b, 0, len(b)) if i == SEGMENT]
    for _, start, stop in todo:
        at = start
        while at < stop:
            id_, a = _vint(b, at, True)
            size, a = _vint(b, a, False)
            z = _open_end(b, a, stop) if size is None else min(stop, a + size)
            if id_ == INFO:
                scale = next((_uint(b, x, y) for i, x, y in elements(b, a, z) if i == TIMESTAMP_SCALE), scale)
            elif id_ == TRACKS:
                for _, x, y in (e for e in elements(b, a, z) if e[0] == TRACK_ENTRY):
                    own = {i: b[p:q] for i, p, q in elements(b, x, y)}
                    tracks[int.from_bytes(own.get(TRACK_NUMBER, b""), "big")] = own.get(CODEC_ID, b"").decode()
            elif id_ == CUES:
                for _, x, y in (e for e in elements(b, a, z) if e[0] == CUE_POINT):
                    own = {i: (p, q) for i, p, q in elements(b, x, y)}
                    pos = {i: _uint(b, p, q) for i, p, q in elements(b, *own[CUE_TRACK_POSITIONS])}
                    cues.append((_uint(b, *own[CUE_TIME]), pos.get(CUE_TRACK, 0), pos.get(CUE_CLUSTER_POSITION, 0)))
            elif id_ == CLUSTER:
                clusters += 1
                packets += _cluster(b, a, z, at - start)
            at = z
    return Media(packets, cues, tracks, scale, clusters)


def _cluster(b: bytes, a: int, z: int, position: int) -> list[Packet]:
    packets, first = [], 0
    for i, x, y in elements(b, a, z):
        if i == TIMESTAMP:
            first = _uint(b, x, y)
        elif i in (SIMPLE_BLOCK, BLOCK_GROUP):
            for p, q in [(x, y)] if i == SIMPLE_BLOCK else [(p, q) for j, p, q in elements(b, x, y) if j == BLOCK]:
                track, rel, flags, frames = block_frames(b, p, q)
                packets += [Packet(track, first + rel, s, n, position, bool(flags & 0x80)) for s, n in frames]
    return packets


def seek(b: bytes, media: Media, timestamp: int) -> list[Packet]:
    """The packets of the cluster that the last cue at or before timestamp names: no other cluster is read."""
    position = max((c for c in media.cues if c[0] <= timestamp), default=(0, 0, -1))[2]
    if position < 0:
        return []
    start = next(a for i, a, _ in elements(b, 0, len(b)) if i == SEGMENT)
    _, a = _vint(b, start + position, True)
    size, a = _vint(b, a, False)
    return _cluster(b, a, _open_end(b, a, len(b)) if size is None else a + size, position)


def padded(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of FRAME."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded, as a Matroska file. A null text counts as empty."""
    small_batches(docs.sparkSession, 512)

    def make():
        def f(b: pa.RecordBatch) -> dict:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            return {"doc_id": b.column(0), "n_bytes": [len(t) for t in texts], "media": [mux(padded(t)) for t in texts]}

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, "doc_id long, n_bytes long, media binary")


_PACKETS = "doc_id long, packet long, track int, timestamp long, start long, size long, cluster long, keyframe boolean"


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of media(doc_id, media): number, track, timestamp, byte range, cluster position."""
    small_batches(media.sparkSession, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa_schema(_PACKETS)
        for b in batches:
            for doc_id, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(doc_id, k, p.track, p.timestamp, p.start, p.size, p.cluster, p.keyframe) for k, p in enumerate(demux(m or b"").packets)]
                for i in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 8192], strict=True), schema.types, strict=True)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, _PACKETS)


def feature(m: Media, payload: bytes) -> str:
    """What the packets and the samples say, in whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"packets={len(m.packets)};clusters={m.clusters};cues={len(m.cues)};last={m.packets[-1].timestamp};sum={x.sum()};energy={(x * x).sum()};turns={(np.diff(np.sign(np.diff(x))) != 0).sum()}"


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text as a media column in the shared folder, read it back, and return digests and a feature.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null text counts as
    empty, which is one packet of spaces. Null and repeated doc_ids keep a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    path = scratch(spark, "media")
    made = media_column(docs)
    made.write.option("compression", "zstd").parquet(path)

    def make():
        def f(b: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for raw in b.column("media").to_pylist():
                m = demux(raw)
                payload = b"".join([raw[p.start : p.start + p.size] for p in m.packets])
                tail = b"".join([raw[p.start : p.start + p.size] for p in seek(raw, m, m.cues[-1][0])])[-16:]
                for c, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), feature(m, payload)), strict=True):
                    out[c].append(v)
            return {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes")} | out

        return f

    stored = spark.read.schema(made.schema).parquet(path)
    return map_batches(stored, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
