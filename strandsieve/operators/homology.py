"""Homology screening as a seed join, hit summaries and interval coverage.

Exact w-mers of queries and references are joined; seeds on one diagonal whose gap is small merge into one ungapped
segment, which is scored on both substrings (match +1, mismatch -2) with Karlin-Altschul statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .seq import kmers

#: Parameters of ungapped nucleotide scores +1 / -2.
LAMBDA, K = 1.33, 0.621
#: Reference positions of one seed that are joined in one task.
PART = 1000
#: Reference positions, both strands, up to which they are sent to all tasks, so that no query k-mer is shuffled (64 MB).
SENT = 1_000_000


_ODD = 0x9E3779B97F4A7C15


def _rolling(text: str, word: int) -> np.ndarray:
    """A 64-bit hash of each run of word letters of an ASCII text."""
    h = np.zeros(max(0, len(text) - word + 1), np.uint64)
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    for i in range(word if len(h) else 0):
        h = h * np.uint64(_ODD) + raw[i : i + len(h)]
    return h


def seed_kmers(df: DataFrame, db: DataFrame, word: int) -> DataFrame:
    """The k-mers of df(seq_id, seq), with their position, that may be among those of db(kmer), by a hash: others are never made to rows.

    db's hashes go to all tasks: for as many k-mers as SENT.
    """
    hashes = db.select("kmer").distinct().mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([int(_rolling(t, word)[0].view(np.int64)) if t.isascii() else 0 for t in b.column(0).to_pylist()], pa.int64())], names=["h"]) for b in bs), "h long")
    known = np.unique(np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64))
    kind = df.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("seq_id"), b.column("seq").to_pylist(), strict=True):
                if not t or len(t) < word or not len(known):
                    continue
                if t.isascii():
                    h = _rolling(t, word)
                    pos = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                else:
                    pos = np.arange(len(t) - word + 1)
                if len(pos):
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(pos), b.schema.field("seq_id").type), pa.array(pos, pa.int64()), pa.array([t[p : p + word] for p in pos.tolist()])], names=["seq_id", "pos", "kmer"])

    return df.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, pos long, kmer string")


def homology_hits(queries: DataFrame, refs: DataFrame, word: int = 16, gap: int = 16, evalue: float = 1e-5, identity: float = 0.0) -> DataFrame:
    """Twelve-column hits of queries(seq_id, seq) in refs(ref_id, seq), both strands, 1-based inclusive coordinates.

    A hit on the minus strand has s_start > s_end. Ordering and ties don't arise: a hit is a (query, subject, strand,
    diagonal, island). Every seed counts, however often it occurs: references of one text are searched as one, and the
    reference positions of a frequent seed are dealt into parts of about PART, each of which meets all query positions.
    Up to SENT reference positions are counted first and then broadcast, and query k-mers whose hash isn't among theirs are
    dropped where they are made; more are joined by a shuffle.
    """
    texts = refs.filter("ref_id IS NOT NULL").groupBy("seq").agg(F.min("ref_id").alias("_text"))
    members = refs.filter("ref_id IS NOT NULL").join(texts, "seq").select("_text", "ref_id")
    one = texts.select(F.col("_text").alias("ref_id"), "seq")
    strands = one.select("ref_id", F.lit("+").alias("strand"), "seq").unionAll(one.select("ref_id", F.lit("-").alias("strand"), T.reverse_complement("seq").alias("seq")))
    db = kmers(strands, word).withColumnRenamed("pos", "s_pos")
    frequent = db.groupBy("kmer").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts")).filter("_parts > 1")
    db = db.join(frequent, "kmer", "left").withColumn("_salt", F.pmod(F.xxhash64("ref_id", "strand", "s_pos"), F.coalesce("_parts", F.lit(1))).cast("int"))
    small = strands.agg(F.coalesce(F.sum(F.greatest(F.length("seq") - word + 1, F.lit(0))), F.lit(0))).first()[0] <= SENT
    own = queries.select("seq_id", "seq")
    found = (seed_kmers(own, db, word) if small else kmers(own, word)).join(F.broadcast(frequent) if small else frequent, "kmer", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    seeds = found.join(F.broadcast(db) if small else db, ["kmer", "_salt"]).select("seq_id", "ref_id", "strand", "pos", (F.col("pos") - F.col("s_pos")).alias("diag"))
    w = Window.partitionBy("seq_id", "ref_id", "strand", "diag").orderBy("pos")
    marked = seeds.withColumn("new", (F.coalesce(F.col("pos") - (F.lag("pos").over(w) + word), F.lit(gap + 1)) > gap).cast("int"))
    spans = marked.withColumn("island", F.sum("new").over(w)).groupBy("seq_id", "ref_id", "strand", "diag", "island").agg(F.min("pos").alias("a"), (F.max("pos") + word).alias("z"))
    q, s = queries.select("seq_id", F.col("seq").alias("q_seq")), strands.select("ref_id", "strand", F.col("seq").alias("s_seq"))
    both = spans.join(q, "seq_id").join(s, ["ref_id", "strand"])
    n = F.col("z") - F.col("a")
    cut = both.select("seq_id", "ref_id", "strand", "diag", "a", "z", n.alias("n"), F.length("q_seq").alias("q_len"), F.length("s_seq").alias("s_len"), F.substring(F.col("q_seq"), (F.col("a") + 1).cast("int"), n.cast("int")).alias("x"), F.substring(F.col("s_seq"), (F.col("a") - F.col("diag") + 1).cast("int"), n.cast("int")).alias("y"))
    same = F.size(F.filter(F.arrays_zip(F.split("x", ""), F.split("y", "")), lambda p: p["0"] == p["1"]))
    scored = cut.withColumn("match", same).withColumn("score", F.col("match") - 2 * (F.col("n") - F.col("match")))
    total = refs.agg(F.sum(F.length("seq")).alias("db_len"))
    scored = scored.crossJoin(F.broadcast(total)).withColumn("bits", (LAMBDA * F.col("score") - math.log(K)) / math.log(2))
    scored = scored.withColumn("e", K * F.col("q_len") * F.col("db_len") * F.exp(-LAMBDA * F.col("score")))
    sa, sz = F.col("a") - F.col("diag") + 1, F.col("z") - F.col("diag")
    plus = F.col("strand") == "+"
    hits = scored.withColumnRenamed("ref_id", "_text").join(members, "_text").select(
        F.col("seq_id").alias("query_id"), F.col("ref_id").alias("subject_id"), (F.col("match") / F.col("n") * 100).alias("percent_identity"), F.col("n").alias("alignment_length"),
        (F.col("n") - F.col("match")).alias("mismatches"), F.lit(0).alias("gap_opens"), (F.col("a") + 1).alias("q_start"), F.col("z").alias("q_end"),
        F.when(plus, sa).otherwise(F.col("s_len") + 1 - sa).alias("s_start"), F.when(plus, sz).otherwise(F.col("s_len") + 1 - sz).alias("s_end"), F.col("e").alias("evalue"), F.col("bits").alias("bit_score"),
    )
    return hits.filter((F.col("evalue") <= evalue) & (F.col("percent_identity") >= identity))


def coverage(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """covered and coverage (per cent) of each record of lengths(seq_id, len): positions under at least one hit."""
    spans = hits.select(F.col("query_id").alias("seq_id"), F.least("q_start", "q_end").alias("a"), F.greatest("q_start", "q_end").alias("z"))
    w = Window.partitionBy("seq_id").orderBy("a", "z")
    before = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = spans.withColumn("from", F.greatest("a", F.coalesce(before + 1, F.col("a"))))
    covered = part.groupBy("seq_id").agg(F.sum(F.greatest(F.col("z") - F.col("from") + 1, F.lit(0))).alias("covered"))
    out = lengths.join(covered, "seq_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.select("seq_id", "covered", F.coalesce(F.col("covered") / F.nullif(F.col("len"), F.lit(0)) * 100, F.lit(0.0)).alias("coverage"))


def hit_summary(hits: DataFrame, records: DataFrame) -> DataFrame:
    """n_hits, max identity and its subject (the first by subject and position of equals) of each record."""
    best = hits.groupBy(F.col("query_id").alias("seq_id")).agg(F.count(F.lit(1)).alias("n_hits"), F.max("percent_identity").alias("max_identity"), F.min_by("subject_id", F.struct(-F.col("percent_identity"), "subject_id", "q_start")).alias("top_subject"))
    return records.select("seq_id").join(best, "seq_id", "left").select("seq_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("max_identity", F.lit(0.0)).alias("max_identity"), "top_subject")


def hit_listing(hits: DataFrame, seqs: DataFrame, first: int = 35, letters: int = 70) -> DataFrame:
    """The first hits of each record with a piece of its sequence."""
    w = Window.partitionBy("query_id").orderBy("q_start", "q_end", "subject_id", "s_start")
    top = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= first)
    cut = F.substring(F.col("seq"), F.col("q_start").cast("int"), F.least(F.lit(letters), F.col("q_end") - F.col("q_start") + 1).cast("int"))
    return top.join(seqs.select(F.col("seq_id").alias("query_id"), "seq"), "query_id").select("query_id", "n", "subject_id", "q_start", "q_end", cut.alias("snippet"))


def has_hit(records: DataFrame, hit_ids: DataFrame) -> DataFrame:
    """Adds hit: whether seq_id is among hit_ids(id)."""
    ids = hit_ids.select(F.col("id").alias("seq_id")).distinct().withColumn("hit", F.lit(True))
    return records.join(ids, "seq_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
