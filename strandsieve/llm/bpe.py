"""Byte-level BPE encoding and decoding of texts of any length by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, in parallel. What follows a boundary
between pre-tokens depends on nothing before it, so where two neighbours have a boundary in common in their overlap they
agree from there on: there the text is cut, and the pieces are encoded in parallel. Decoding concatenates raw bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pa_schema, small_batches
from .encoding import ByteEncoder, encoder

#: A match is sure when this many characters follow it in the chunk: no alternative looks further.
_MARGIN = 4
_ENCODED = "row long, doc_id long, piece int, ids binary"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def boundaries(text: str, pattern) -> list[int]:
    """Ends of the pre-tokens that stay the same whatever follows the text, after a character that isn't white space.

    A piece that ends in white space could not be told from a text that ends there, so no cut is made there.
    """
    last = len(text) - _MARGIN
    return [m.end() for m in pattern.finditer(text) if m.end() <= last and not text[m.end() - 1].isspace()]


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(chunk))).cast("int")
    cut = docs.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cut.withColumn("text", F.substring(F.col("text"), F.col("k") * chunk + 1, F.when(F.col("k") < F.col("n") - 1, chunk + overlap).otherwise(2**31 - 1)))


def _bounds(chunks: DataFrame, chunk: int, overlap: int, path: str) -> DataFrame:
    """Adds head and tail: the boundaries in the overlaps with the chunk before and the chunk after, in the document; and
    free: those of tail that white space follows. No pre-token goes from other characters on to white space, so these
    are boundaries wherever a chunk begins."""
    schema = "row long, doc_id long, n int, k int, text string, head array<int>, tail array<int>, free array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(encoder(ByteEncoder, path).pattern)
        for b in batches:
            head, tail, free = [], [], []
            for text, k in zip(b.column("text").to_pylist(), b.column("k").to_pylist(), strict=True):
                at = boundaries(text, pattern)
                head.append([k * chunk + x for x in at if x < overlap])
                tail.append([k * chunk + x for x in at if chunk <= x < chunk + overlap])
                free.append([x for x in tail[-1] if text[x - k * chunk].isspace()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "n", "k", "text")), *(pa.array(x, pa.list_(pa.int32())) for x in (head, tail, free))], names=["row", "doc_id", "n", "k", "text", "head", "tail", "free"])

    return chunks.select("row", "doc_id", "n", "k", "text").mapInArrow(run, schema)


def stitched_pieces(docs: DataFrame, path: str, chunk: int = 32768, overlap: int = 1024) -> DataFrame:
    """(row, doc_id, piece, text) of docs(row, doc_id, text): the pieces of each text in order.

    Chunks whose overlap has no boundary in common stay together in one piece, up to the next overlap with a boundary
    that is one wherever a chunk begins: what the first boundaries of a chunk are worth isn't known after such a gap.
    """
    spread = _chunks(docs, chunk, overlap).repartition("row", "k")
    w = Window.partitionBy("row").orderBy("k")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    found = _bounds(spread, chunk, overlap, path).withColumn("both", F.array_intersect("tail", F.lead("head").over(w)))
    found = found.withColumn("sure", F.array_min(F.array_intersect("both", "free"))).withColumn("sync", F.coalesce("sure", F.array_min("both")))
    found = found.withColumn("since", F.coalesce(F.count("sure").over(before), F.lit(0)))
    gaps = F.sum(F.col("sync").isNull().cast("int")).over(Window.partitionBy("row", "since").orderBy("k"))
    found = found.withColumn("gaps", gaps).withColumn("cut", F.when(F.col("sure").isNotNull() | (F.col("gaps") == 0), F.col("sync")))
    found = found.withColumns({"piece": F.coalesce(F.count("cut").over(before), F.lit(0)).cast("int"), "from": F.coalesce(F.max("cut").over(before), F.lit(0))})
    # the part of the text that is the chunk's own: without the overlap the chunks of a text are the text
    start = F.greatest(F.col("from"), F.col("k") * chunk)
    end = F.coalesce(F.col("cut"), F.when(F.col("k") < F.col("n") - 1, (F.col("k") + 1) * chunk).otherwise(2**31 - 1))
    own = F.substring(F.col("text"), (start - F.col("k") * chunk + 1).cast("int"), (end - start).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", own.alias("t")))), lambda x: x["t"]), "")
    return found.groupBy("row", "doc_id", "piece").agg(joined.alias("text"))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, piece, text) with the ids for the text: four bytes each, little-endian."""
    e = encoder(ByteEncoder, path)
    for b in batches:
        ids = [np.array(e.encode(t or ""), "<u4").tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "piece")), pa.array(ids, pa.binary())], schema=pa_schema(_ENCODED))


def decode(ids: list[int], raw: list[bytes]) -> bytes:
    """The bytes of the ids; they may end within a character."""
    return b"".join([raw[i] for i in ids])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Pieces in order, those of a row one after the other: the number of ids and the digests of the ids and of what they
    decode to. Only one piece is held at a time."""
    e = encoder(ByteEncoder, path)
    now, doc, n, ids_sha, raw_sha = None, None, 0, None, None
    for b in batches:
        out = []
        for row, doc_id, raw in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "ids")), strict=True):
            if row != now:
                if ids_sha:
                    out.append((doc, n, ids_sha.hexdigest(), raw_sha.hexdigest()))
                now, doc, n, ids_sha, raw_sha = row, doc_id, 0, hashlib.sha256(), hashlib.sha256()
            ids = np.frombuffer(raw, "<u4").tolist()
            if ids:
                ids_sha.update(((" " if n else "") + " ".join([e.decimal[i] for i in ids])).encode())
                raw_sha.update(decode(ids, e.raw))
                n += len(ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), pa_schema(_DIGESTS).types, strict=True)], schema=pa_schema(_DIGESTS))
    if ids_sha:
        yield pa.RecordBatch.from_pydict(dict(zip(pa_schema(_DIGESTS).names, ([doc], [n], [ids_sha.hexdigest()], [raw_sha.hexdigest()]), strict=True)), schema=pa_schema(_DIGESTS))


def _rows(docs: DataFrame, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """docs as (row, doc_id, piece, text): texts that are one chunk, and so one piece, and longer ones without pieces yet."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    more = F.length("text") > chunk + overlap
    return rows.filter(~more).select("row", "doc_id", F.lit(0).alias("piece"), "text"), rows.filter(more)


def encoded(docs: DataFrame, path: str, chunk: int = 32768, overlap: int = 1024) -> DataFrame:
    """(row, doc_id, piece, ids): the ids of each piece of each document; row tells documents of one id apart.

    A text of one chunk is one piece and isn't shuffled. A null text counts as empty: one piece without ids.
    """
    small_batches(docs.sparkSession, 256)
    single, longer = _rows(docs, chunk, overlap)
    pieces = stitched_pieces(longer, path, chunk, overlap).repartition("row", "piece")
    return single.unionByName(pieces).mapInArrow(lambda batches: _encode(batches, path), _ENCODED)


def encoded_digests(docs: DataFrame, path: str, chunk: int = 32768, overlap: int = 1024) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The pieces of a longer text are encoded in parallel and come together in order, as ids, where they are hashed one by
    one; a text of one chunk is hashed where it is encoded. A null text counts as empty: no tokens, the digests of the
    empty string. Null and repeated doc_ids keep a row each; other columns play no part; an empty table gives no row.
    """
    small_batches(docs.sparkSession, 256)
    single, longer = _rows(docs, chunk, overlap)
    pieces = stitched_pieces(longer, path, chunk, overlap).repartition("row", "piece").mapInArrow(lambda batches: _encode(batches, path), _ENCODED)
    ordered = pieces.repartition("row").sortWithinPartitions("row", "piece")
    return single.mapInArrow(lambda batches: _digest(_encode(batches, path), path), _DIGESTS).unionAll(ordered.mapInArrow(lambda batches: _digest(batches, path), _DIGESTS))
