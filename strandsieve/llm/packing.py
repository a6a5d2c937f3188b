"""Documents into sequences of tokens: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, small_batches
from .encoding import ByteEncoder, encoder

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, largest first, each into the first bin with room.

    A tournament tree holds the room of every bin at its leaves and in each inner node the larger of its two; the way
    down to the first bin with room takes a step a level.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pieces(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """Each document's ids and end id, cut into pieces of at most length tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ByteEncoder, path).encode_all
        schema = pa_schema(_PIECES)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                whole = zlib.crc32(raw)
                for at in range(0, len(ids), length):
                    part = raw[4 * at : 4 * (at + length)]
                    out.append((doc_id, at, len(part) // 4, whole if len(part) == len(raw) else zlib.crc32(part), len(ids), whole))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, group_docs: int = 8192) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut into pieces of length tokens and a shorter last one. Documents are dealt by a hash into groups of
    about group_docs, and each group packs its pieces first-fit decreasing; ties go by doc_id and start. A null text
    counts as empty, so that its document is the end id alone; null and repeated doc_ids are packed like others. An
    empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group_docs))
    dealt = pieces(docs, path, length, end_id).withColumn("group", F.pmod(F.xxhash64("doc_id", "doc_crc32"), F.lit(groups)))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), length)
        base = t.column("group")[0].as_py() << 32
        t = t.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))
        return t.select([x.split()[0] for x in _PLACED.split(", ")])

    return dealt.groupBy("group").applyInArrow(place, _PLACED)
