"""Fragments, sliding windows, k-mers and tracks of sequences(seq_id, seq, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import text as T
from .ranges import mixed
from .terms import kmer_rows, sorted_by, whole_groups

#: Windows that are cut from one block of a sequence.
PER_BLOCK = 256


def windows(df: DataFrame, n: Column, size: Column | int, step: Column | int, out: str = "frag", seq: str = "seq", names: tuple[str, str] = ("idx", "start")) -> DataFrame:
    """n windows of size letters, step apart: adds idx and start (from 0; called as in names) and out. Rows with n < 1 give none.

    Sequences of ASCII letters are cut as bytes, where a place is found at once: time grows with the letters that are cut. Others are cut
    as characters, for which each block is looked for from the beginning.
    """
    size, step = (F.lit(x) if isinstance(x, int) else x for x in (size, step))
    rest = [c for c in df.columns if c != seq]
    ready = df.withColumns({"_n": n.cast("int"), "_size": size.cast("int"), "_step": step.cast("int")}).filter("_n >= 1")
    ascii_ = F.octet_length(seq) == F.length(seq)
    ready = ready.select(*rest, "_n", "_size", "_step", F.when(ascii_, F.col(seq).cast("binary")).alias("_bytes"), F.when(~ascii_, F.col(seq)).alias("_chars"))
    ready = ready.withColumn("_b", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / PER_BLOCK).cast("int"))))
    at, letters = F.col("_b") * PER_BLOCK * F.col("_step") + 1, F.lit(PER_BLOCK - 1) * F.col("_step") + F.col("_size")
    ready = ready.select(*rest, "_n", "_size", "_step", "_b", *(F.substring(F.col(c), at, letters).alias(c) for c in ("_bytes", "_chars")))
    many = F.least(F.lit(PER_BLOCK), F.col("_n") - F.col("_b") * PER_BLOCK)

    def cut(i: Column) -> Column:
        place = (i * F.col("_step") + 1).cast("int")
        return F.coalesce(F.substring(F.col("_bytes"), place, F.col("_size")).cast("string"), F.substring(F.col("_chars"), place, F.col("_size")))

    ready = ready.select(*rest, "_step", "_b", F.posexplode(F.transform(F.sequence(F.lit(0), many - 1), cut)).alias("_i", out))
    idx = F.col("_b") * PER_BLOCK + F.col("_i")
    return ready.select(*rest, idx.cast("long").alias(names[0]), (idx * F.col("_step")).cast("long").alias(names[1]), out)


def fragments(df: DataFrame, size: int = 500, least: int = 4) -> DataFrame:
    """Pieces of size letters; the last may be shorter, but not shorter than least."""
    n = F.length("seq")
    return windows(df, F.ceil(n / size), size, size).filter(F.length("frag") >= least)


def whole_fragments(df: DataFrame, size: int | Column = 500, least: int = 4) -> DataFrame:
    """Pieces of size letters without the tail; a sequence shorter than size is kept whole."""
    n, s = F.length("seq"), F.lit(size) if isinstance(size, int) else size
    return windows(df, F.when(n >= s, F.floor((n - s) / s) + 1).otherwise(1), s, s).filter(F.length("frag") >= least)


def sliding(df: DataFrame, size: Column | int, step: Column | int) -> DataFrame:
    """Full windows only, step apart."""
    n, w, s = F.length("seq"), *(F.lit(x) if isinstance(x, int) else x for x in (size, step))
    return windows(df, F.when(n >= w, F.floor((n - w) / s) + 1).otherwise(0), w, s, out="win")


def default_step(size: int) -> int:
    return max(50, size // 5)


def kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """All overlapping k-mers with their position (from 0)."""
    return windows(df, F.length(seq) - k + 1, k, 1, out="kmer", seq=seq, names=("_at", "pos")).drop("_at")


def tokens(df: DataFrame, ks: tuple[int, ...] = (4, 6, 8), seq: str = "frag") -> DataFrame:
    """k, pos and token (k{k}_{kmer}) of all overlapping k-mers for each k, made in one pass; for fragments, which are short."""
    n = F.length(seq)

    def of(k: int) -> Column:
        one = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(F.lit(k).alias("k"), (i - 1).cast("long").alias("pos"), F.concat(F.lit(f"k{k}_"), F.substring(F.col(seq), i.cast("int"), F.lit(k))).alias("token")))
        return F.when(n >= k, one).otherwise(F.array().cast("array<struct<k:int,pos:bigint,token:string>>"))

    every = F.concat(*map(of, ks))
    rest = [c for c in df.columns if c != seq]
    return df.select(*rest, F.explode(every).alias("_t")).select(*rest, "_t.pos", "_t.k", "_t.token")


def kmer_counts(df: DataFrame, k: int, by: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """Count, first position and relative frequency of each k-mer of each record.

    Records are dealt out by their key, and their k-mers are counted where they are made: no k-mer is shuffled, sorted or written, and
    no row is made for each place. A task holds the k-mers of a few records at a time.
    """
    own = sorted_by(df.select(*by, "seq"), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, by, "seq"):
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            number, kmer, cnt, pos = kmer_rows(t, group, k, "seq")
            total = np.bincount(number, cnt, minlength=len(first)).astype(np.int64)[number]
            for a in range(0, len(number), 1 << 17):
                z = a + (1 << 17)
                keys = [t.column(c).combine_chunks().take(pa.array(first[number[a:z]])) for c in by]
                yield pa.RecordBatch.from_arrays([*keys, kmer[a:z], *map(pa.array, (cnt[a:z], pos[a:z], total[a:z], cnt[a:z] / total[a:z]))], names=[*by, "kmer", "cnt", "first_pos", "total", "freq"])

    made = StructType([*(own.schema[c] for c in by), StructField("kmer", StringType()), *(StructField(c, LongType()) for c in ("cnt", "first_pos", "total")), StructField("freq", DoubleType())])
    return own.mapInArrow(run, made)


def pooled_counts(df: DataFrame, k: int, first: int = 20, most: int = 50_000, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """k-mer counts over the first records by seq_id (of at least least letters, cut to most), and their total."""
    chosen = df.filter(F.length("seq") >= least).select("seq_id", "seq").orderBy("seq_id").limit(first).select("seq_id", F.substring("seq", 1, most).alias("seq"))
    return kmers(chosen, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("bg")), chosen.agg(F.coalesce(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0))), F.lit(0)).alias("bg_total"))


def composition(df: DataFrame, seq: str = "frag") -> DataFrame:
    """Adds gc, cpg and gc3 of fragments."""
    return df.withColumns({"gc": T.gc_share(seq), "cpg": T.cpg_share(seq), "gc3": T.gc3_share(seq)})


def kmer_vectors(frags: DataFrame, by: tuple[str, ...], k: int = 4, seq: str = "frag") -> DataFrame:
    """Relative frequencies of the k-mers over A, T, G and C, those that occur: by, kmer, freq."""
    known = kmers(frags.select(*by, seq).repartition(*by), k, seq).filter(~F.col("kmer").contains("N"))
    counted = known.groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(*by, "kmer", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*by))).alias("freq"))


def gc_track(df: DataFrame) -> DataFrame:
    """x and gc of windows of 20 to 100 letters, half a window apart."""
    n = F.length("seq")
    w = F.least(F.lit(100), F.greatest(F.lit(20), F.floor(n / 20))).cast("int")
    sized = df.withColumn("w", w)
    s = F.greatest(F.lit(1), F.floor(F.col("w") / 2)).cast("int")
    n_win = F.greatest(F.lit(1), F.floor((n - F.col("w")) / s) + 1)
    return windows(sized.filter(F.length("seq") > 0), n_win, F.col("w"), s, out="win").select("seq_id", (F.col("start") + F.floor(F.col("w") / 2)).alias("x"), T.gc_percent("win").alias("gc"))


def entropy_track(df: DataFrame) -> DataFrame:
    """x and entropy of windows of 32 to 80 letters, half a window apart."""
    n = F.length("seq")
    sized = df.withColumn("w", F.least(F.lit(80), F.greatest(F.lit(32), F.floor(n / 15))).cast("int"))
    s = F.greatest(F.lit(10), F.floor(F.col("w") / 2)).cast("int")
    n_win = F.greatest(F.lit(1), F.floor((n - F.col("w")) / s) + 1)
    return windows(sized.filter(F.length("seq") > 0), n_win, F.col("w"), s, out="win").select("seq_id", (F.col("start") + F.floor(F.col("w") / 2)).alias("x"), T.entropy("win").alias("entropy"))


def sampled_fragments(df: DataFrame, n: int, seed: int = 42, least: int = 20, most: int = 150) -> DataFrame:
    """n random pieces of 20 to 150 letters: record, length and start by arithmetic hashes of the draw's number.

    Records are numbered first, in order of a hash of their ids; a window runs over at most a million hash values.
    """
    usable = df.filter(F.length("seq") >= least).select("seq_id", "seq")
    # a number for each record: its rank among the records of its own hash value, after those of lower ones
    hashed = usable.select("seq_id", mixed("seq_id", seed).alias("_h"))
    sizes = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c"))
    base = sizes.select("_h", F.coalesce(F.sum("_c").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_h").orderBy("seq_id")) - 1
    numbered = hashed.withColumn("_r", rank).join(base, "_h").select("seq_id", (F.col("_base") + F.col("_r")).alias("no"))
    total = usable.count()
    if not total:
        return df.sparkSession.createDataFrame([], "frag_id string, seq_id long, frag string")
    draw = lambda salt: mixed("id", seed + salt)
    draws = df.sparkSession.range(n).select("id", F.pmod(draw(0) * 7919 + F.col("id"), F.lit(total)).alias("no"), draw(11).alias("u"), draw(29).alias("v"))
    got = draws.join(numbered, "no").join(usable, "seq_id")
    size = (least + F.pmod(F.col("u"), F.least(F.lit(most), F.length("seq")) - least + 1)).cast("int")
    got = got.withColumn("size", size)
    start = F.pmod(F.col("v"), F.length("seq") - F.col("size") + 1).cast("int")
    return got.select(F.format_string("frag_%06d", "id").alias("frag_id"), "seq_id", F.substring(F.col("seq"), start + 1, F.col("size")).alias("frag"))
