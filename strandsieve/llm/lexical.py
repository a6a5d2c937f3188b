"""Ranked lexical search over bags of the items' terms.

Of each document only its counts of the items' terms and its length matter. Documents with the same counts and the same
length part m have the same score for every item: they are one class, found by a hash and told apart by all their bytes, and
scored once. Each task keeps the best classes of each item and nothing else travels; the members of the classes that
are left over all tasks are then looked up in ascending doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, map_batches, pa_schema, small_batches, staged

#: Bytes of texts that stand between terms, in ASCII.
_BETWEEN = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TO_TERMS = bytes(0x20 if c in _BETWEEN else c for c in bytes(range(256)).lower())
_PAIR = np.dtype([("term", "<i4"), ("tf", "<i4")])
#: Bytes of terms, and 16 for each, of the items that one pass over the documents serves.
PASS_BYTES = 16 << 20


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z in lower case."""
    return text.translate(_TO_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of each item, each term once; rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and (found := sorted(set(terms(t)))):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array(found, pa.binary())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "item_id long, term binary").distinct()


def _bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, bag): n counts a document's terms with repeats; its bag has the number of each term of the vocabulary that it
    holds and its count, by number, as 32-bit pairs."""

    def make():
        number = {t: i for i, t in enumerate(vocabulary)}

        def f(b: pa.RecordBatch) -> dict:
            n, bags = [], []
            for t in b.column(1).to_pylist():
                found = terms(t or b"")
                n.append(len(found))
                held = sorted((number[w], k) for w, k in Counter(filter(number.__contains__, found)).items())
                bags.append(np.array(held, _PAIR).tobytes())
            return {"doc_id": b.column(0), "n": n, "bag": bags}

        return f

    return map_batches(docs, make, "doc_id long, n long, bag binary")


def _counts(bags: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and for each term of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, with_terms, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            n = b.column("n").to_numpy()
            with_terms, total = with_terms + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(np.frombuffer(b"".join(b.column("bag").to_pylist()), _PAIR)["term"], minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([total, with_terms, *df[held].tolist()], pa.int64())], names=["what", "count"])

    found = {r.what: r.count_ for r in bags.mapInArrow(run, "what long, count long").groupBy("what").agg(F.sum("count").alias("count_")).collect()}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(i, 0) for i in range(size)], np.int64)


def _best(batches: Iterator[pa.RecordBatch], weight: np.ndarray, first: np.ndarray, items: np.ndarray, ids: list[int | None], most: int) -> Iterator[pa.RecordBatch]:
    """Classes (cls, m, bag, least): of each item the classes with the most highest scores, equal scores by least.

    Items of term t are items[first[t] : first[t + 1]].
    """
    best = np.empty((0, 4), np.int64)  # item, score, least, cls
    n_items = len(ids)
    bar = np.ones(n_items, np.int64)
    for b in batches:
        size = np.array([len(x) // _PAIR.itemsize for x in b.column("bag").to_pylist()])
        cls, m, least = (b.column(c).to_numpy() for c in ("cls", "m", "least"))
        step = max(1, (1 << 22) // n_items)
        for a in range(0, len(size), step):
            pairs = np.frombuffer(b"".join(b.column("bag")[a : a + step].to_pylist()), _PAIR)
            row = np.repeat(np.arange(len(size[a : a + step])), size[a : a + step])
            tf, term = pairs["tf"].astype(np.int64), pairs["term"]
            part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[a + row]))
            degree = first[term + 1] - first[term]
            ends = np.cumsum(degree)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[term] - (ends - degree), degree)
            score = np.zeros(len(size[a : a + step]) * n_items, np.int64)
            np.add.at(score, np.repeat(row, degree) * n_items + items[at], np.repeat(part, degree))
            r, i = np.nonzero(score.reshape(-1, n_items) >= bar)
            best = np.concatenate([best, np.stack([i, score.reshape(-1, n_items)[r, i], least[a + r], cls[a + r]], axis=1)])
            best = best[np.lexsort((best[:, 3], best[:, 2], -best[:, 1], best[:, 0]))]
            begin = np.searchsorted(best[:, 0], np.arange(n_items + 1))
            rank = np.arange(len(best)) - begin[best[:, 0]]
            best = best[rank < most]
            full = begin[1:] - begin[:-1] >= most
            last = np.searchsorted(best[:, 0], np.arange(n_items), "right") - 1
            bar[full] = best[last[full], 1]
    if len(best):
        item, score, least, cls = np.ascontiguousarray(best.T)
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in item], pa.int64()), *map(pa.array, (score, least, cls))], schema=pa_schema("item_id long, score long, least long, cls long"))


def _members(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of the rows (doc, m, bag, ...) of a task the most smallest docs of each class."""
    held: dict[tuple[int, bytes], list[int]] = {}
    for b in batches:
        for doc, m, bag in zip(b.column("doc").to_pylist(), b.column("m").to_pylist(), b.column("bag").to_pylist(), strict=True):
            docs = held.setdefault((m, bag), [])
            docs.append(doc)
            if len(docs) >= 4 * most:
                docs[:] = sorted(docs)[:most]
    if held:
        m, bag = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(bag, pa.binary()), pa.array([sorted(d)[:most] for d in held.values()], pa.list_(pa.int64()))], names=["m", "bag", "docs"])


def _ranked(docs: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """One pass over docs(doc_id, text) for the items of wanted(item_id, term)."""
    by_item: dict[int | None, list[bytes]] = {}
    for r in wanted.collect():
        by_item.setdefault(r.item_id, []).append(bytes(r.term))
    ids = list(by_item)
    vocabulary = sorted({t for found in by_item.values() for t in found})
    number = {t: i for i, t in enumerate(vocabulary)}
    pairs = np.array(sorted((number[t], k) for k, i in enumerate(ids) for t in by_item[i]), np.int64).reshape(-1, 2)
    first, items = np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1)), pairs[:, 1]

    bags = staged(_bags(docs, vocabulary), "bags")
    n_docs, n_terms, df = _counts(bags, len(vocabulary))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    # in decimals, as 50 * n * N may be beyond a long where its quotient isn't
    share = F.expr(f"cast(cast(50 * n AS decimal(19, 0)) * cast({n_docs} AS decimal(19, 0)) div cast({max(n_terms, 1)} AS decimal(19, 0)) AS long)")
    held = bags.filter(F.length("bag") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), (50 + share).alias("m"), "bag")
    held = held.withColumn("h", F.xxhash64("m", "bag"))
    classes = held.groupBy("h", "m", "bag").agg(F.min("doc").alias("least"))
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")

    found = classes.select("cls", "m", "bag", "least").mapInArrow(lambda b: _best(b, weight, first, items, ids, most), "item_id long, score long, least long, cls long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "least", "cls")
    best = staged(found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).select("item_id", "score", "cls"), "best-classes")
    best = staged(best.join(classes, "cls").select("item_id", "score", "h", "m", "bag"), "best-bags")

    near = held.join(best.select("h").distinct(), "h", "left_semi").select("doc", "m", "bag")
    members = near.mapInArrow(lambda b: _members(b, most), "m long, bag binary, docs array<long>")
    members = members.groupBy("m", "bag").agg(F.slice(F.array_sort(F.flatten(F.collect_list("docs"))), 1, most).alias("docs"))
    hits = best.join(members, ["m", "bag"]).select("item_id", "score", F.explode("docs").alias("doc"))
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc")
    hits = hits.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)
    return hits.select("item_id", "rank", F.when(F.col("doc") < NO_ID, F.col("doc")).alias("doc_id"), "score")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = 50, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each item (item_id, text) its most highest-scoring documents (doc_id, text) with a score above 0: item_id, rank,
    doc_id, score. Equal scores go by ascending doc_id, null ones last.

    Terms are runs of digits, letters and all characters beyond ASCII, with A-Z in lower case; null texts have none, long ones
    are read whole. Rows of one item_id, null too, are one item, with the terms of all its rows; repeated rows of docs are documents
    of their own. Items without terms, or whose terms no document holds, give no row. Other columns count for nothing, whatever their
    names. An empty table of either kind gives an empty result.

    The items' terms go to every task. More than about pass_bytes of them are dealt by item to several passes over the
    documents, each for its own items; no item is cut.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    wanted = staged(item_terms(items), "item-terms")
    size = wanted.agg(F.sum(F.length("term") + 16).alias("size")).first().size or 0
    passes = -(-size // pass_bytes)
    if passes <= 1:
        return _ranked(docs, wanted, most)
    out = None
    for k in range(passes):
        found = _ranked(docs, wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k), most)
        out = found if out is None else out.unionAll(found)
    return out
