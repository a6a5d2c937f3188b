"""Known and over-represented motifs."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .seq import kmer_counts, kmers, pooled_counts
from .terms import runs, whole_groups

#: Laboratory motifs by name.
LAB_MOTIFS = {
    "T7 promoter": "TAATACGACTCACTATAGGG",
    "CMV promoter core": "TGACATTGATTATTGACTAG",
    "SV40 polyA signal": "AATAAAATATCTTTATTTTC",
    "Kanamycin resistance motif": "ATGAGCCATATTCAACGGGA",
    "Ampicillin resistance motif": "ATGAATTCACTGGCCGTCGT",
    "Lac operator (pUC/lacZ)": "AATTGTGAGCGGATAACAATT",
    "pUC19/M13 reverse primer site": "CAGGAAACAGCTATGAC",
    "pUC19/M13 forward primer site": "GTAAAACGACGGCCAGT",
}


def motif_table(spark: SparkSession, motifs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(motifs.items()), "name string, pattern string")


def motif_scan(df: DataFrame, motifs: dict[str, str]) -> DataFrame:
    """(seq_id, name) of each motif that a record holds, forward strand. One column expression for each motif: no join."""
    found = F.array_compact(F.array(*(F.when(F.contains("seq", F.lit(p)), F.lit(n)) for n, p in motifs.items())))
    return df.select("seq_id", F.explode(found).alias("name"))


def motif_positions(df: DataFrame, motifs: dict[str, str]) -> DataFrame:
    """(seq_id, name, start, end) of every occurrence, 1-based and inclusive, overlapping ones too: k-mers of the motifs'
    lengths joined to the motifs."""
    table = F.broadcast(motif_table(df.sparkSession, motifs))
    out = None
    for k in sorted({len(p) for p in motifs.values()}):
        hit = kmers(df.select("seq_id", "seq"), k).join(table.filter(F.length("pattern") == k), F.col("kmer") == F.col("pattern"))
        hit = hit.select("seq_id", "name", (F.col("pos") + 1).alias("start"), (F.col("pos") + k).alias("end"))
        out = hit if out is None else out.unionAll(hit)
    return out


def motif_strands(df: DataFrame, motifs: dict[str, str]) -> DataFrame:
    """seq_id, name, strand, start, end (1-based, inclusive, on the given strand's letters read forwards) of all occurrences of motifs
    and of their reverse complements in df(seq_id, seq), overlapping ones too.

    One automaton of all patterns runs over each sequence once, however many motifs there are; they are a library that every task holds. A
    palindrome is found on both strands. Null sequences have no occurrence; an empty motif is none.
    """
    turned = str.maketrans("ATGC", "TACG")
    kind = df.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pattern: dict[str, list[tuple[str, str]]] = {}
        for name, p in motifs.items():
            for strand, x in (("+", p), ("-", p[::-1].translate(turned))):
                if x:
                    by_pattern.setdefault(x, []).append((name, strand))
        automaton = ahocorasick.Automaton()
        for p, named in by_pattern.items():
            automaton.add_word(p, (len(p), named))
        automaton.make_automaton()
        for b in batches:
            found = [(i, name, strand, end - n + 2, end + 1) for i, t in enumerate(b.column("seq").to_pylist()) if t and by_pattern for end, (n, named) in automaton.iter(t) for name, strand in named]
            if found:
                row, name, strand, start, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("seq_id").take(pa.array(row)), pa.array(name), pa.array(strand), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["seq_id", "name", "strand", "start", "end"])

    return df.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, name string, strand string, start long, end long")


def enriched_kmers(df: DataFrame, k: int = 6, top: int = 10, background: DataFrame | None = None, first: int = 20) -> DataFrame:
    """The top k-mers of each record by their frequency over a pooled background with add-one smoothing.

    The background is counted once: at most 5^k k-mers, so its table is broadcast. Ties go to the k-mer that comes first.
    """
    bg, total = pooled_counts(df if background is None else background, k, first)
    counted = kmer_counts(df.select("seq_id", "seq"), k)
    # broadcast: a record's rows stay together in their task, so they are ranked there
    joined = counted.join(F.broadcast(bg), "kmer", "left").crossJoin(F.broadcast(total))
    fold = (F.col("cnt") / F.col("total")) / ((F.coalesce("bg", F.lit(0)) + 1) / (F.col("bg_total") + 4**k))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_groups(batches, ("seq_id",), "kmer"):
            order = np.lexsort((t.column("first_pos").to_numpy(), -t.column("fold").to_numpy(), group))
            _, starts = runs(group)
            rank = np.arange(len(group)) - starts[group] + 1
            keep = rank <= top
            out = t.take(pa.array(order[keep])).append_column("rank", pa.array(rank[keep].astype(np.int32)))
            yield from out.combine_chunks().to_batches()

    rows = joined.select("seq_id", "kmer", "cnt", "first_pos", fold.alias("fold"))
    ranked = rows.mapInArrow(best, StructType([*rows.schema.fields, StructField("rank", IntegerType())]))
    return ranked.select("seq_id", "rank", "kmer", "cnt", "first_pos", "fold")


def enrichment_feature(enriched: DataFrame, df: DataFrame) -> DataFrame:
    """Each record's largest fold, 0 without one."""
    best = enriched.groupBy("seq_id").agg(F.max("fold").alias("fold"))
    return df.select("seq_id").join(best, "seq_id", "left").select("seq_id", F.coalesce("fold", F.lit(0.0)).alias("max_fold"))

