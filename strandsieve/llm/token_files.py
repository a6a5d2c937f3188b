"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds ids of bits bits each, the least a vocabulary needs, in blocks of BLOCK ids; each block begins on a byte.
After the blocks stand their offsets, then for each document its id, first token and number of tokens, and last a
trailer of fixed size. Any range of ids is read from the blocks that hold it and unpacked by numpy at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, pa_schema, scratch, small_batches, staged
from .encoding import WordEncoder, encoder
from .files import reading, writing

MAGIC = b"TOKENPK1"
BLOCK = 16384
#: bits, blocks, documents, ids, offset of the block offsets.
_TRAILER = struct.Struct("<IIQQQ8s")
_DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "<u1"), ("start", "<u8"), ("n", "<u8")])


def width(vocabulary: int) -> int:
    """Bits for ids below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def _lanes(bits: int):
    """(id, word, shift) of 64 ids in bits words of 64 bits; an id that reaches into the next word comes twice."""
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        yield j, word, shift
        if shift + bits > 64:
            yield j, word + 1, shift - 64


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each, lowest bit first."""
    size = -(-len(ids) * bits // 8)
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint64)
    for j, word, shift in _lanes(bits):
        out[:, word] |= rows[:, j] << np.uint64(shift) if shift >= 0 else rows[:, j] >> np.uint64(-shift)
    return out.astype("<u8").tobytes()[:size]


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    groups = -(-n // 64)
    words = np.frombuffer(raw.ljust(groups * bits * 8, b"\0"), "<u8", groups * bits).reshape(groups, bits)
    out = np.zeros((groups, 64), np.uint64)
    for j, word, shift in _lanes(bits):
        out[:, j] |= words[:, word] >> np.uint64(shift) if shift >= 0 else words[:, word] << np.uint64(-shift)
    return (out & np.uint64((1 << bits) - 1)).astype("<u4").reshape(-1)[:n]


class TokenWriter:
    """Writes documents' ids to a stream, block by block; finish() ends the file."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.held, self.n_held = out, bits, [], 0
        self.offsets, self.documents, self.at, self.n = [], [], len(MAGIC), 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is not None, self.n, len(ids)))
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held)
        at = 0
        while len(ids) - at >= least and at < len(ids):
            packed = pack_bits(ids[at : at + BLOCK], self.bits)
            self.offsets.append(self.at)
            self.out.write(packed)
            self.at += len(packed)
            at += BLOCK
        self.held, self.n_held = [ids[at:]], max(0, len(ids) - at)

    def finish(self) -> None:
        if self.n_held:
            self._flush(1)
        index = self.at
        self.out.write(np.array([*self.offsets, index], "<u8").tobytes())
        self.out.write(np.array(self.documents, _DOCUMENT).tobytes())
        self.out.write(_TRAILER.pack(self.bits, len(self.offsets), len(self.documents), self.n, index, MAGIC))


class TokenReader:
    """Documents and ranges of ids of a file."""

    def __init__(self, f):
        self.f = f
        f.seek(f.size() - _TRAILER.size)
        self.bits, blocks, documents, self.n, index, magic = _TRAILER.unpack(f.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        f.seek(index)
        self.offsets = np.frombuffer(f.read(8 * (blocks + 1)), "<u8")
        self.documents = np.frombuffer(f.read(documents * _DOCUMENT.itemsize), _DOCUMENT)
        self._at, self._ids = -1, None

    def block(self, k: int) -> np.ndarray:
        if k != self._at:
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            self.f.seek(a)
            self._at, self._ids = k, unpack_bits(self.f.read(b - a), min(BLOCK, self.n - k * BLOCK), self.bits)
        return self._ids

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from start on."""
        parts = [self.block(k)[max(0, start - k * BLOCK) : start + n - k * BLOCK] for k in range(start // BLOCK, -(-(start + n) // BLOCK))]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> DataFrame:
    """Encode all documents, each with an end id, into files of folder in ascending doc_id order.

    One file for each range of doc_ids. Returns the manifest: file, ordinal, n_ids, n_docs, base (ids of all files
    before it).
    """
    spark = docs.sparkSession
    small_batches(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", id_or_last("doc_id").alias("_order"))
    ordered = ordered.repartitionByRange("_order").sortWithinPartitions("_order", "text").select("doc_id", "text")
    schema = "file string, ordinal long, n_ids long, n_docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        words = encoder(WordEncoder, path)
        end = np.array([end_id], words.dtype).tobytes()
        ordinal = TaskContext.get().partitionId()
        name = f"{folder}/tokens-{ordinal:08d}.bin"
        with writing(name) as out:
            w = TokenWriter(out, width(max(words.tokenizer.get_vocab_size(), end_id + 1)))
            b = first
            while b is not None:
                for doc_id, raw in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                    w.add(doc_id, np.frombuffer(raw + end, words.dtype))
                b = next(batches, None)
            w.finish()
        yield pa.RecordBatch.from_pydict({"file": [name], "ordinal": [ordinal], "n_ids": [w.n], "n_docs": [len(w.documents)]}, schema=pa_schema(schema))

    files = staged(ordered.mapInArrow(run, schema), "token-manifest")
    # a row for each file: few enough for one task
    before = F.sum("n_ids").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("base", F.coalesce(before, F.lit(0)))


def _runs(documents: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """Documents in a row with about most ids together, 8192 at most; a longer document is a run of its own."""
    i = 0
    while i < len(documents):
        j = int(np.searchsorted(documents["start"], documents["start"][i] + np.uint64(most)))
        j = min(max(j, i + 1), i + 8192)
        yield documents[i:j]
        i = j


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with reading(name) as f:
                    r = TokenReader(f)
                    for part in _runs(r.documents):
                        # the run's blocks are decoded once; a document is a slice of their bytes
                        first = int(part["start"][0])
                        raw = memoryview(r.ids(first, int(part["start"][-1] + part["n"][-1]) - first).view(np.uint8))
                        at, to = 4 * (part["start"].astype(np.int64) - first), 4 * part["n"].astype(np.int64)
                        crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), to.tolist(), strict=True)]
                        ids = [int(x) if known else None for x, known in zip(part["doc_id"], part["known"], strict=True)]
                        yield pa.RecordBatch.from_pydict({"doc_id": ids, "start": part["start"].astype(np.int64) + base, "n_tokens": part["n"].astype(np.int64), "ids_crc32": crc}, schema=pa_schema(schema))

    return manifest.select("file", "base").repartition(n).mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write all documents' ids to files in the shared folder and return what is read from them.

    One row per document: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32. A null
    text counts as empty: the end id alone. Documents without a doc_id stand last; rows of one doc_id in order of
    their texts. An empty table writes no file and gives no row.
    """
    return read_token_files(write_token_files(docs, path, scratch(docs.sparkSession, "token-files"), end_id))
