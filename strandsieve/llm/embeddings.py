"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions and the projections cut into cells of one width; a table's
bucket is the cells of several projections together. Vectors of a cosine c lie sqrt(2 - 2c) apart, so near ones share a
bucket of some table with a known likelihood. Buckets are compared by exact cosines. A pair counts in the first table
whose bucket it shares and in no later one, so links are counted where they are found and never travel: of each
bucket only the vectors' counts and edges that span its components leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pa_schema, small_batches, staged
from .components import connected_components

_ODD = np.uint64(0x9E3779B97F4A7C15)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, of any finite size; rows without a direction are zero."""
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        x = np.where(top > 0, x / top, 0.0)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)


def bucket_codes(u: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """For each unit vector its bucket in each table, as 32 bits; vectors of one code are of one bucket."""
    rng = np.random.default_rng([seed, u.shape[1]])
    directions, shift = rng.standard_normal((u.shape[1], tables * projections)), rng.uniform(0, width, tables * projections)
    cells = np.floor((u @ directions + shift) / width).astype(np.int64).view(np.uint64).reshape(len(u), tables, projections)
    h = np.zeros((len(u), tables), np.uint64)
    for i in range(projections):
        h = (h ^ cells[:, :, i]) * _ODD
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def compare_bucket(x: np.ndarray, codes: np.ndarray, weight: np.ndarray, block: np.ndarray | None, table: int, cosine: float, stripe: int = 512) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of a bucket's unit vectors the weight that each links to, and edges (positions) that span the linked components.

    Pairs that share the code of an earlier table count there. block: only pairs of two blocks count.
    """
    n = len(x)
    linked, links = np.zeros((n, n), bool), np.zeros(n, np.int64)
    for i in range(0, n, stripe):
        near = x[i : i + stripe] @ x.T >= cosine
        near[np.arange(len(near)), np.arange(i, i + len(near))] = False
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        near = near[rows]
        for t in range(table):
            near &= codes[rows + i, t][:, None] != codes[:, t]
        if block is not None:
            near &= block[rows + i][:, None] != block
        linked[rows + i], links[rows + i] = near, near @ weight
    edges: list[tuple[int, int]] = []
    rest = linked.any(axis=1)
    while rest.any():
        seed = int(np.argmax(rest))
        rest[seed], front = False, np.array([seed])
        while len(front):
            reached = linked[front].any(axis=0) & rest
            front = np.flatnonzero(reached)
            rest[front] = False
            edges += [(seed, int(k)) for k in front]
    return links, edges


def _classes(batches: Iterator[pa.RecordBatch], tables: int, projections: int, width: float, seed: int) -> Iterator[pa.RecordBatch]:
    """(cls, label, v, n) with each vector's codes, one after the other in binary."""
    for b in batches:
        raw = b.column("v").to_pylist()
        codes: list[bytes | None] = [None] * len(raw)
        size = np.array([len(v) for v in raw])
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            found = bucket_codes(unit(np.frombuffer(b"".join(raw[i] for i in at), "<f8").reshape(len(at), -1)), tables, projections, width, seed)
            for i, c in zip(at, found, strict=True):
                codes[i] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary())], names=[*b.schema.names, "codes"])


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by keys, one bucket or pair of a bucket's blocks after the other: rows (a, links) and edges (a, b)."""
    schema = pa_schema("a long, b long, links long")

    def found(rows: pa.Table) -> pa.RecordBatch | None:
        x = unit(np.frombuffer(b"".join(rows.column("v").to_pylist()), "<f8").reshape(len(rows), -1))
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int32).reshape(len(rows), -1)
        cls, n, block = (rows.column(c).to_numpy() for c in ("cls", "n", "block"))
        links, edges = compare_bucket(x, codes, n, block if rows.column("i")[0] != rows.column("j")[0] else None, rows.column("table")[0].as_py(), cosine)
        at = np.flatnonzero(links)
        if not len(at):
            return None
        a, b = (cls[[e[k] for e in edges]] for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cls[at], a])), pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(b)]), pa.concat_arrays([pa.array(links[at]), pa.nulls(len(a), pa.int64())])], schema=schema)

    held: list[pa.RecordBatch] = []
    at_key = None
    for batch in batches:
        key = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
        starts = [k for k in range(len(key)) if k == 0 or key[k] != key[k - 1]]
        for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
            if key[a] != at_key:
                if sum(map(len, held)) > 1 and (out := found(pa.Table.from_batches(held))):
                    yield out
                held, at_key = [], key[a]
            held.append(batch.slice(a, b - a))
    if sum(map(len, held)) > 1 and (out := found(pa.Table.from_batches(held))):
        yield out


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = 32, projections: int = 12, width: float = 2.5, block: int = 2048, seed: int = 13) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label and one length link when their cosine, in doubles, is at least cosine. n_links counts the other
    rows that a row links to directly, component_id is the smallest vec_id reachable over links, kept says that it is the
    row's own. Vectors that are null, zero or hold null, NaN or infinite components, and rows without a label, link with nothing.
    Repeated rows are vectors like others: they link, and those of the smallest vec_id all stay. A null vec_id is never a
    component's id unless it has no other, and then stays. Other columns count for nothing, whatever their names. An empty table gives an
    empty result.

    Equal vectors of a label are compared as one and counted by their number. With the parameters as given two vectors at
    exactly 0.93 share a bucket in some table with a likelihood of 99.96 %, nearer ones more surely, and those at a cosine of
    0.1 share that of a table with 0.16 %. A bucket of more than block vectors is cut by hash, and each pair of its blocks is compared by itself.
    """
    small_batches(vectors.sparkSession)
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("label").isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))) & ~F.isnan(c)) & F.exists(x, lambda c: c != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(F.coalesce(usable, F.lit(False)), x).alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [None if r is None else np.array(r, "<f8").tobytes() for r in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(v, pa.binary())], names=["vec_id", "label", "v"])

    kind = own.schema["label"].dataType.simpleString()
    own = staged(own.mapInArrow(packed, f"vec_id long, label {kind}, v binary"), "vectors")
    known = own.filter("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    known = staged(known.withColumn("cls", F.monotonically_increasing_id()), "distinct-vectors")
    schema = f"cls long, label {kind}, v binary, n long, codes binary"
    coded = known.select("cls", "label", "v", "n").mapInArrow(lambda b: _classes(b, tables, projections, width, seed), schema)
    coded = staged(coded, "coded-vectors")

    code = F.substring("codes", F.col("table") * 4 + 1, F.lit(4))
    keyed = coded.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).select("*", F.length("v").alias("size"), code.alias("code"))
    bucket = ["label", "size", "table", "code"]
    large = staged(keyed.groupBy(*bucket).count().filter(F.col("count") > block).select(*bucket, F.ceil(F.col("count") / block).alias("blocks")), "large-buckets")
    if large.isEmpty():
        cells = keyed.withColumns({c: F.lit(0).cast("long") for c in ("block", "i", "j")})
    else:
        cells = keyed.join(large, bucket, "left").fillna(1, ["blocks"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    cell = [*bucket, "i", "j"]
    cells = cells.select(*cell, "block", "cls", "v", "n", "codes").repartition(*cell).sortWithinPartitions(*cell)
    found = staged(cells.mapInArrow(lambda b: _cells(b, cell, cosine), "a long, b long, links long"), "near-vectors")

    root = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = known.join(links, known["cls"] == links["a"], "left").join(root, F.col("cls") == F.col("node"), "left")
    of_class = staged(of_class.select("label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "vector-roots")
    name = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(name, "root").select("label", "v", "n_links", "component_id")
    out = own.filter("v IS NOT NULL").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = own.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
