"""Removal of word sequences that repeat across documents, by super-k-mers.

A window is so many consecutive words of one document. Each has a minimiser: the least hash of the shorter word runs in
it. Consecutive windows with one minimiser make a super-k-mer, which travels as one packed string to the minimiser's
bucket; equal windows have equal minimisers, so they meet there, and sorting the bucket's windows finds for each the
smallest document. Only super-k-mers whose minimiser occurs in two documents travel. A bucket with many of them is
dealt by document into salted parts, each sorted alone; of each window the part's own smallest document then stands for
it among the parts, where windows are told apart by 128-bit digests of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_last, map_batches, pa_schema, small_batches, split_by_keys, staged

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Super-k-mers in a part of a bucket, about. A task holds one part at a time, of at most 128 windows each.
PART = 250


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_PLACE = _mixed(np.arange(1, 65, dtype=np.uint64) * _ODD) | np.uint64(1)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts that lie in raw between offsets, and each word's text.

    The hashes only choose buckets: words of one hash cost work and change no result.
    """
    letter = ~_WHITE[raw]
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    ends[:-1] &= ~letter[1:]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    begins[at] = letter[at]
    last = offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = letter[last]
    first, size = np.flatnonzero(begins), np.flatnonzero(ends) + 1 - np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.flatnonzero(letter)
    heads = np.cumsum(size) - size
    place = np.arange(len(inside)) - np.repeat(heads, size)
    h = np.add.reduceat(_BYTE[raw[inside]] * _PLACE[place & 63], heads)
    return _mixed(h + size.astype(np.uint64)), np.searchsorted(offsets, first, "right") - 1


def super_kmers(h: np.ndarray, text: np.ndarray, window: int, run: int, longest: int = 128) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, minimiser) of all maximal runs of windows with one minimiser, up to longest."""
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    m = h[: len(h) - run + 1].copy()
    for j in range(1, run):
        m = m * _ODD + h[j : len(h) - run + 1 + j]
    m, span, want = _mixed(m), 1, window - run + 1
    while span < want:
        step = min(span, want - span)
        m = np.minimum(m[:-step], m[step:])
        span += step
    at = np.flatnonzero(text[:n] == text[window - 1 :])
    if not len(at):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) != 1) | (m[at[1:]] != m[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(cut)
    size = np.diff(np.append(first, len(at)))
    if size.max() > longest:
        parts = -(-size // longest)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - k * longest, longest)
        first = np.repeat(first, parts) + k * longest
    at = at[first]
    return text[at], at - np.searchsorted(text, text[at]), size, m[at]


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls and where its rows begin and end."""
    c = b.column("text")
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    data = c.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds d, the id that orders documents, and key, which tells rows of one id apart by their texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({"d": id_or_last("doc_id"), "key": F.xxhash64(text), "text": text})


def repeated_spans(docs: DataFrame, window: int = 50, run: int = 12, part: int = PART) -> DataFrame:
    """(d, key, spans) of each text with windows that also start in a document with a smaller id: word ranges, end not
    included."""
    spark = docs.sparkSession
    small_batches(spark, 512)
    keyed = _keyed(docs.select("doc_id", "text")).select("d", "key", "text")

    def find():
        def f(b: pa.RecordBatch) -> dict:
            text, at, n, m = super_kmers(*word_hashes(*_columns(b)), window, run)
            return {"d": b.column("d").to_numpy()[text], "key": b.column("key").to_numpy()[text], "at": at, "n": n, "m": m.view(np.int64)}

        return f

    kmers = staged(map_batches(keyed, find, "d long, key long, at long, n long, m long"), "super-kmers")
    shared = kmers.groupBy("m").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("c")).filter("low < high")
    shared = staged(shared.select("m", F.ceil(F.col("c") / part).alias("salts")), "shared-minimisers")
    travel = kmers.join(shared, "m").withColumn("salt", F.pmod(F.xxhash64("d", "key", "at"), F.col("salts")))
    travel = travel.groupBy("d", "key").agg(F.collect_set(F.struct("at", "n", "m", "salt", "salts")).alias("go"))
    packed = "m long, salt long, salts long, d long, key long, at long, words binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa_schema(packed)
        for b in batches:
            out = []
            for d, key, text, go in zip(*(b.column(c).to_pylist() for c in ("d", "key", "text", "go")), strict=True):
                words = text.split()
                for x in go:
                    out.append((x["m"], x["salt"], x["salts"], d, key, x["at"], b" ".join(words[x["at"] : x["at"] + x["n"] + window - 1])))
            for i in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 4096], strict=True), schema.types, strict=True)], schema=schema)

    moved = keyed.join(travel, ["d", "key"]).mapInArrow(cut, packed)
    judged = "d long, key long, start long, end long, digest binary"
    found = staged(moved.repartition("m", "salt").sortWithinPartitions("m", "salt").mapInArrow(lambda rows: _sorted_buckets(rows, window, judged), judged), "repeated")
    spans = found.filter("digest IS NULL").select("d", "key", "start", "end")
    # windows whose part had no smaller document: the smallest of all parts decides
    open_ = found.filter("digest IS NOT NULL")
    low = open_.groupBy("digest").agg(F.min("d").alias("low"), F.max("d").alias("high")).filter("low < high").select("digest", "low")
    late = open_.join(staged(low, "lowest"), "digest").filter("d > low").select("d", "key", "start", "end")
    return spans.unionAll(late).groupBy("d", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _sorted_buckets(rows: Iterator[pa.RecordBatch], window: int, schema: str) -> Iterator[pa.RecordBatch]:
    """Super-k-mers sorted by bucket and salt to the spans that a smaller document of the part has as well; and, of
    salted buckets, the windows of each part's smallest documents with a digest of their words."""
    arrow = pa_schema(schema)
    held, last, out = [], None, []

    def flush() -> None:
        windows = []
        for _, _, salts, d, key, at, words in held:
            ends = [-1, *(i for i, c in enumerate(words) if c == 32), len(words)] if len(words) < 64 else [-1, *np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist(), len(words)]
            windows += [(words[ends[i] + 1 : ends[i + window]], d, key, at + i, salts) for i in range(len(ends) - window)]
        windows.sort()
        text, low = None, 0
        gone = []
        for w, d, key, at, salts in windows:
            if w != text:
                text, low = w, d
            if d > low:
                gone.append((d, key, at))
            elif salts > 1:
                out.append((d, key, at, at + window, xxhash.xxh3_128_digest(w)))
        gone.sort()
        before = None
        for d, key, at in gone:
            if before and before[:2] == [d, key] and at <= before[3]:
                before[3] = at + window
            else:
                if before:
                    out.append((*before, None))
                before = [d, key, at, at + window]
        if before:
            out.append((*before, None))

    def batches() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(out), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 8192], strict=True), arrow.types, strict=True)], schema=arrow)
        out.clear()

    for b in rows:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[:2] != last:
                if len(held) > 1 or held and held[0][2] > 1:
                    flush()
                held, last = [], x[:2]
            held.append(x)
        if len(out) > 8192:
            yield from batches()
    if len(held) > 1 or held and held[0][2] > 1:
        flush()
    yield from batches()


def _kept(text: bytes, spans) -> tuple[int, list[bytes]]:
    words = text.split()
    if spans is None or not len(spans):
        return len(words), words
    keep = np.ones(len(words), bool)
    for s in spans:
        keep[s["start"] : s["end"]] = False
    return len(words), [words[i] for i in np.flatnonzero(keep).tolist()]


def substring_dedup(docs: DataFrame, window: int = 50, run: int = 12, part: int = PART) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    Words are runs of other characters than space, tab and line ends, unchanged. A word goes if a window over it also
    starts in a document with a smaller doc_id, in the input. A null text has no words; a document without a doc_id
    counts as larger than all others; rows of one doc_id don't count against each other. An empty table gives no row.
    """
    spans = repeated_spans(docs, window, run, part)
    rows = _keyed(docs.select("doc_id", "text")).join(spans, ["d", "key"], "left").select(F.col("doc_id").cast("long"), "text", "spans")

    def make():
        def f(b: pa.RecordBatch) -> dict:
            done = [_kept(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            return {"doc_id": b.column(0), "n_words": [n for n, _ in done], "n_removed": [n - len(w) for n, w in done], "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for _, w in done]}

        return f

    return map_batches(rows, make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50, run: int = 12, part: int = PART) -> DataFrame:
    """docs with the repeated words taken out: texts that lose words are their other words, joined by one space; all
    others stay as they are. n_chars follows the text.

    All rows and columns stay, whatever their names. A null or empty text stays as it is; a document without a doc_id
    counts as larger than all others; rows of one doc_id don't count against each other, and rows of one doc_id and text
    lose the same words. A text that is all repeated becomes empty. Long texts are read whole. An empty table stays empty.
    """
    spans = staged(repeated_spans(docs, window, run, part), "spans")
    ids = docs.select(F.struct("*").alias("row"), id_or_last("doc_id").alias("d"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("key"))
    ids, whole = split_by_keys(ids, F.col("key"), F.col("key"), spans)
    rows = ids.join(spans, ["d", "key"], "left")

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        return pd.Series([t if s is None else b" ".join(_kept(t.encode(), s)[1]).decode() for t, s in zip(text, spans, strict=True)])

    lost = F.col("spans").isNotNull()
    rows = rows.withColumn("left", F.when(lost, cut("row.text", "spans")))
    row = F.col("row").withField("text", F.when(lost, F.col("left")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(lost, F.length("left").cast("long")).otherwise(F.col("row.n_chars")))
    return rows.select(row.alias("row")).select("row.*").unionByName(whole.select("row.*"))
