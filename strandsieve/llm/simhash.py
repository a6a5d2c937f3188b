"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code (23, 12) is perfect: each
23-bit word lies within 3 bits of one codeword. A segment's keys are the 12-bit indices of all codewords within 4
bits of it: one when it is at most 2 bits from its codeword, else six. Two segments that differ in at most 2 bits
always share a key. Of three segments that differ in at most 4 bits together, two differ in at most 2 each, so linked
fingerprints share a pair of keys of some two segments: they meet in a bucket of one of 3 x 2^24, and are verified there
on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pa_schema, small_batches, split_by_keys, staged
from .components import connected_components

#: Generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and by syndrome the error patterns of weight 4 or less (padded)."""

    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    low = np.array([rest(v) for v in range(1 << 12)], np.int64)
    high = np.array([rest(v << 12) for v in range(1 << 11)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[low[e & 4095] ^ high[e >> 12]].append(e)
    errors = np.full((1 << 11, 6), -1, np.int64)
    for s, e in enumerate(found):
        errors[s, : len(e)] = e
    return low, high, errors


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """For each 23-bit value six codeword indices, -1 where there are fewer."""
    low, high, errors = _tables()
    e = errors[low[segment & 4095] ^ high[segment >> 12]]
    return np.where(e < 0, -1, (segment[:, None] ^ e) >> 11)


def bucket_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all buckets that the fingerprints (uint64) enter."""
    keys = [segment_keys((fingerprints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    rows, out = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        pair = np.where((keys[i][:, :, None] >= 0) & (keys[j][:, None, :] >= 0), (k << 24) | (keys[i][:, :, None] << 12) | keys[j][:, None, :], -1)
        row, a, b = np.nonzero(pair >= 0)
        rows.append(row)
        out.append(pair[row, a, b])
    return np.concatenate(rows), np.concatenate(out)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text with A-Z in lower case; of fewer words the whole sequence is one."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[:-words].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def simhash(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i, n in enumerate(ones.tolist()) if 2 * n > len(h))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a long. A null text counts as empty: fp 0."""
    small_batches(docs.sparkSession)

    def make():
        def f(b: pa.RecordBatch) -> dict:
            fp = np.array([simhash(shingle_hashes(t or b"", words)) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            return {"doc_id": b.column(0), "fp": fp}

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, "doc_id long, fp long")


def _links(fp: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Star edges of the components of fp (positions): a search that compares what it has reached with the rest."""
    a, b, rest = [], [], np.arange(len(fp))
    while len(rest) > 1:
        seed, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for x in fp[front]:
                open_ = np.flatnonzero(~near)
                if not len(open_):
                    break
                near[open_[np.bitwise_count(fp[rest[open_]] ^ x) <= bits]] = True
            front, rest = rest[near], rest[~near]
            a += [int(seed)] * len(front)
            b += front.tolist()
    return a, b


def _tree(fp: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of at most bits bits of a minimum spanning tree of the rows of fp: for any lower limit they still connect
    what that limit connects."""
    a, b = [], []
    near, to, left = np.full(len(fp), 1 << 30), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    now = 0
    for _ in range(len(fp) - 1):
        left[now] = False
        d = np.bitwise_count(fp ^ fp[now]).sum(axis=1, dtype=np.int64)
        closer = d < near
        near[closer], to[closer] = d[closer], now
        now = int(np.argmin(np.where(left, near, 1 << 30)))
        if near[now] <= bits:
            a.append(int(to[now]))
            b.append(now)
    return a, b


def _found(width: int) -> tuple[str, list[str], list[str], list[str]]:
    """Schema of what buckets yield, and its columns, for fingerprints of width longs."""
    a, b, fp = (([f"{c}{i or ''}" for i in range(width)]) for c in ("a", "b", "fp"))
    return ", ".join(f"{c} long" for c in (*a, *b, "bucket", "block", *fp)), a, b, fp


def _compare(rows: Iterator[pa.RecordBatch], bits: int, most: int, width: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, ...) sorted by key: edges (a, b) of buckets of up to most rows; of larger ones the rows with their
    block, and last a row with the number of blocks alone."""
    schema = pa_schema(_found(width)[0])
    span = (lambda fp: _links(fp[:, 0], bits)) if width == 1 else (lambda fp: _tree(fp, bits))

    def out(a=None, b=None, bucket=None, block=None, fp=None) -> pa.RecordBatch:
        n = next((len(x) for x in (a, fp) if x is not None), 1)
        columns = []
        for x in (a, b):
            columns += [None] * width if x is None else list(x.view(np.int64).T)
        columns += [None if v is None else np.full(n, v) for v in (bucket, block)]
        columns += [None] * width if fp is None else list(fp.view(np.int64).T)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(np.ascontiguousarray(c), t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def edges(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.diff(key)) + 1
        first, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(key)]]))
        a, b = [], []
        small = np.repeat(size <= 8, size)
        for lag in range(1, 8):
            at = np.flatnonzero((key[:-lag] == key[lag:]) & small[:-lag])
            at = at[np.bitwise_count(fp[at] ^ fp[at + lag]).sum(axis=1, dtype=np.int64) <= bits]
            a.append(fp[at])
            b.append(fp[at + lag])
        for i, n in zip(first[size > 8], size[size > 8], strict=True):
            x, y = span(own := fp[i : i + n])
            a.append(own[x])
            b.append(own[y])
        return np.concatenate(a), np.concatenate(b)

    held_key, held, block = None, np.empty((0, width), np.uint64), 0
    for batch in rows:
        key = batch.column(0).to_numpy()
        fp = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64)
        if len(held):
            key, fp = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([held, fp])
        if block and key[0] != held_key:
            yield out(bucket=held_key, block=block)
            block = 0
        last = int(np.searchsorted(key, key[-1]))
        if block and last:  # the end of a bucket that has been cut into blocks
            n = int(np.searchsorted(key, held_key, "right"))
            yield out(bucket=held_key, block=block, fp=fp[:n])
            yield out(bucket=held_key, block=block + 1)
            key, fp, last, block = key[n:], fp[n:], last - n, 0
        # a batch may itself hold a bucket that is too large
        if last:
            k, n = np.unique(key[:last], return_counts=True)
            mark = np.ones(last, bool)
            for big in k[n > most]:
                at = np.flatnonzero(key[:last] == big)
                mark[at] = False
                for i in range(0, len(at), most):
                    yield out(bucket=int(big), block=i // most, fp=fp[at[i : i + most]])
                yield out(bucket=int(big), block=-(-len(at) // most))
            if mark.any():
                a, b = edges(key[:last][mark], fp[:last][mark])
                if len(a):
                    yield out(a, b)
        held_key, held = int(key[-1]), fp[last:]
        while len(held) > most:
            yield out(bucket=held_key, block=block, fp=held[:most])
            held, block = held[most:], block + 1
    if len(held):
        if block:
            yield out(bucket=held_key, block=block, fp=held)
            yield out(bucket=held_key, block=block + 1)
        elif len(held) > 1:
            a, b = edges(np.full(len(held), held_key), held)
            if len(a):
                yield out(a, b)


def _bucket_edges(keyed: DataFrame, bits: int, block: int, width: int) -> DataFrame:
    """Edges of the buckets of keyed(key, fp, ...): a, b, and a1, b1 where fingerprints are two longs."""
    schema, a, b, fp = _found(width)
    found = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda rows: _compare(rows, bits, block, width), schema), "near")
    edges = found.filter("a IS NOT NULL").select(*a, *b)
    held = found.filter("bucket IS NOT NULL")
    if held.isEmpty():
        return edges
    blocks = held.filter("fp IS NULL").select("bucket", F.col("block").alias("n"))
    pairs = held.filter("fp IS NOT NULL").join(blocks, "bucket").select("bucket", *fp, "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.filter("block <> other").select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *fp)

    def pair(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(c).to_numpy() for c in fp], axis=1).view(np.uint64)
        i, j = _links(x[:, 0], bits) if width == 1 else _tree(x, bits)
        return pa.table({c: v for names, at in ((a, i), (b, j)) for c, v in zip(names, np.ascontiguousarray(x[at].view(np.int64).T.reshape(width, -1)), strict=True)})

    return edges.unionAll(pairs.groupBy("bucket", "i", "j").applyInArrow(pair, ", ".join(f"{c} long" for c in (*a, *b))))


def near_edges(distinct: DataFrame, bits: int = 4, block: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all of the distinct fingerprints fp that differ in at most bits (4 or fewer) bits.

    Not all pairs: each bucket yields stars that span its components. A bucket of more than block fingerprints is cut
    into blocks of that size, and each pair of blocks is compared in a task of its own.
    """

    def make():
        def f(b: pa.RecordBatch) -> dict:
            fp = b.column(0).to_numpy()
            row, key = bucket_keys(fp.view(np.uint64))
            return {"key": key, "fp": fp[row]}

        return f

    keys = map_batches(distinct.select("fp"), make, "key long, fp long")
    return _bucket_edges(keys, bits, block, 1)


def simhash_components(docs: DataFrame, words: int = 4, bits: int = 4, block: int = 4096) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id, the smallest doc_id reachable over links.

    Fingerprints link when they differ in at most bits bits; documents without words have fingerprint 0 and link like
    any other. A null text counts as empty; a null doc_id is never a component's id unless it has no other. Repeated
    rows are of one component, as are all rows of one fingerprint. An empty table gives an empty result.
    """
    own = staged(fingerprints(docs, words), "fingerprints")
    least = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = connected_components(near_edges(least, bits, block))
    root = least.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    root = staged(root, "roots")
    name = root.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(root.select("fp", "root").join(name, "root"), "fp").select("doc_id", "fp", "component_id")


def similar_links(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 4096) -> DataFrame:
    """Links (x, y) between documents (doc, text) whose sets of word shingles have a Jaccard similarity of at least
    similarity: they connect all that candidate pairs of that similarity connect.

    Two independent 64-bit fingerprints of the set of shingles each give Golay keys; in a bucket all 128 bits count. They
    differ in a share of acos(2j / (1 + j)) / pi of the bits for a similarity j; twice the spread is allowed on top.
    Candidates are the pairs of a bucket within that limit. The edges of each bucket's minimum spanning tree are verified
    on the whole texts first. Failed edges join the components that are left to families; in these all pairs within the
    limit are verified, block by block, so no candidate goes untried unless verified links join it.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = int(128 * p + 2 * np.sqrt(128 * p * (1 - p)))
    small_batches(docs.sparkSession)

    def prints():
        def f(b: pa.RecordBatch) -> dict:
            both = []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t or b"", words))
                both.append((simhash(h), simhash(_other(h)), xxhash.xxh64_intdigest(h.tobytes()), len(h)))
            fp = np.array([x[:3] for x in both], np.uint64).reshape(-1, 3).view(np.int64)
            return {"doc": b.column(0), "f": fp[:, 0], "g": fp[:, 1], "h": fp[:, 2], "n": [x[3] for x in both]}

        return f

    own = staged(map_batches(docs.select("doc", F.col("text").cast("binary")), prints, "doc long, f long, g long, h long, n long"), "fingerprints").filter("n > 0")
    sets_ = staged(own.groupBy("f", "g", "h", "n").agg(F.min("doc").alias("doc")), "distinct-sets")
    least = staged(sets_.groupBy("f", "g").agg(F.min("doc").alias("doc")), "distinct-fingerprints")

    edges = _bucket_edges(_golay_keys(least.select("f", "g")).withColumnsRenamed({"f": "fp", "g": "fp1"}), bits, block, 2).distinct()
    for side, f, g in (("x", "a", "a1"), ("y", "b", "b1")):
        edges = edges.join(least.select(F.col("f").alias(f), F.col("g").alias(g), F.col("doc").alias(side)), [f, g])
    alike = own.join(sets_.withColumnRenamed("doc", "x"), ["f", "g", "h", "n"]).filter("doc <> x").select("x", F.col("doc").alias("y"))
    same = sets_.join(least.withColumnRenamed("doc", "x"), ["f", "g"]).filter("doc <> x").select("x", F.col("doc").alias("y"))
    pairs = staged(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionAll(same).unionAll(alike).distinct(), "pairs")
    first = staged(_verified(docs, pairs, words, similarity), "links")

    # failed edges between components: only what the components that they part hold can have links that weren't tried
    failed = pairs.join(first, ["x", "y"], "left_anti")
    if failed.isEmpty():
        return first
    root = staged(connected_components(first.select(F.col("x").alias("a"), F.col("y").alias("b"))), "verified")
    for side in ("x", "y"):
        failed = failed.join(root.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    family = connected_components(failed.select(F.col("rx").alias("a"), F.col("ry").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("family"))
    nodes = sets_.join(root.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")).join(family, "root")
    return first.unionAll(_within(docs, staged(nodes, "open"), words, bits, similarity, min(block, 128)))


def _golay_keys(rows: DataFrame) -> DataFrame:
    """The rows (f, g, ...: longs) with each key of each of the two fingerprints: key, f, g, ..."""
    names = rows.columns

    def keys():
        def f(b: pa.RecordBatch) -> dict:
            held = np.stack([c.to_numpy() for c in b.columns], axis=1)
            out = [bucket_keys(np.ascontiguousarray(held[:, k]).view(np.uint64)) for k in range(2)]
            row = np.concatenate([r for r, _ in out])
            return {"key": np.concatenate([key | k << 26 for k, (_, key) in enumerate(out)])} | {c: held[row, i] for i, c in enumerate(names)}

        return f

    return map_batches(rows, keys, ", ".join(f"{c} long" for c in ("key", *names)))


def _within(docs: DataFrame, nodes: DataFrame, words: int, bits: int, similarity: float, block: int) -> DataFrame:
    """Links (x, y) between nodes(doc, f, g, n, root, family) of one family that differ in root: they connect what all pairs
    of at most bits bits and that similarity connect.

    A family is cut by hash into blocks of about block documents and 2^19 shingles; each pair of blocks is compared in one
    go, with its documents' sets of shingles. So a set travels once for each block and never once for each pair.
    """
    size = nodes.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / (1 << 19))).cast("long").alias("blocks"))
    dealt = nodes.join(size, "family").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    known = _sets(docs, nodes.select("doc"), words)
    cells = dealt.join(known, "doc").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "f", "g", "doc", "root", "set")
    cells = cells.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return cells.mapInArrow(lambda batches: _cells(batches, bits, similarity), "x long, y long")


def _cells(batches: Iterator[pa.RecordBatch], bits: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (family, i, j): links of each such cell; where i and j differ only pairs of two blocks count."""

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j, block, f, g, doc, root = (rows.column(c).to_numpy() for c in ("i", "j", "block", "f", "g", "doc", "root"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        n = np.array([len(x) for x in sets], np.float64)
        near = np.bitwise_count((f[:, None] ^ f).view(np.uint64)).astype(np.int16) + np.bitwise_count((g[:, None] ^ g).view(np.uint64)) <= bits
        near &= np.minimum(n[:, None], n) >= similarity * np.maximum(n[:, None], n) - 1e-9
        near &= np.triu(root[:, None] != root)
        if i[0] != j[0]:
            near &= block[:, None] != block
        if not near.any():
            return
        same = _common(sets)
        near &= same >= similarity * (n[:, None] + n - same) - 1e-9
        parent: dict[int, int] = {}

        def top(r: int) -> int:
            while (up := parent.get(r, r)) != r:
                r = up
            return r

        out = []
        for a, b in np.argwhere(near).tolist():
            u, v = top(int(root[a])), top(int(root[b]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((int(doc[a]), int(doc[b])))
        if out:
            yield pa.RecordBatch.from_pydict({"x": [min(p) for p in out], "y": [max(p) for p in out]}, schema=pa_schema("x long, y long"))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("family", "i", "j")], axis=1)
        at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(at, at[1:], strict=False):
            if held and a == 0 and [held[-1].column(c)[0].as_py() for c in ("family", "i", "j")] == key[0].tolist():
                held.append(batch.slice(a, b - a))
                continue
            if held and sum(map(len, held)) > 1:
                yield from links(pa.Table.from_batches(held))
            held = [batch.slice(a, b - a)]
    if held and sum(map(len, held)) > 1:
        yield from links(pa.Table.from_batches(held))


def _common(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many elements each two of the sets share, by products of incidence matrices of width elements at a time."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    row, col = row[keep], place[at[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, (a, a + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        out += part @ part.T
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc, set) of the wanted documents: the sorted hashes of their word shingles, each once."""

    def sets():
        def f(b: pa.RecordBatch) -> dict:
            return {"doc": b.column(0), "set": [np.unique(shingle_hashes(t or b"", words)).tobytes() for t in b.column(1).to_pylist()]}

        return f

    near = split_by_keys(docs.select("doc", F.col("text").cast("binary").alias("text")), F.col("doc"), F.col("doc"), wanted)[0]
    return staged(map_batches(near.join(wanted, "doc", "left_semi"), sets, "doc long, set binary"), "shingle-sets")


def _verified(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (x, y) whose documents' sets of shingles are alike to similarity or more."""
    known = _sets(docs, pairs.select(F.col("x").alias("doc")).unionAll(pairs.select(F.col("y").alias("doc"))).distinct(), words)
    both = pairs.join(known.select(F.col("doc").alias("x"), F.col("set").alias("u")), "x").join(known.select(F.col("doc").alias("y"), F.col("set").alias("v")), "y")

    def verify():
        def f(b: pa.RecordBatch) -> dict:
            keep = []
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                m, n = np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)
                same = len(np.intersect1d(m, n, assume_unique=True))
                keep.append(same >= similarity * (len(m) + len(n) - same))
            keep = np.array(keep, bool)
            return {"x": b.column("x").to_numpy()[keep], "y": b.column("y").to_numpy()[keep]}

        return f

    return map_batches(both.select("x", "y", "u", "v"), verify, "x long, y long")


def _other(h: np.ndarray) -> np.ndarray:
    """A second hash of the same shingles."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keep_near(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, with all columns, whatever their names.

    Documents without words (null and empty texts too), and without a doc_id, stay. Rows of one doc_id count as one
    document: they stay or go together. Equal texts link. Long texts are read whole. An empty table stays empty.
    """
    ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    links = similar_links(ids, words, similarity)
    gone = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).filter("node <> root").select(F.col("node").alias("_gone"))
    gone = staged(gone, "near-gone")
    may, rest = split_by_keys(docs, F.col("doc_id").cast("long"), F.col("_gone"), gone)
    return rest.unionByName(may.join(gone, may["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns))
