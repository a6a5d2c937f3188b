"""Gapped local alignments: two seeds on one diagonal or one long one, then an X-drop extension by a banded affine dynamic program.

Seeds are joined as in homology.py, but low-complexity and ambiguous ones start nothing (a soft mask: extensions run through
them). Where two seeds that don't overlap lie near each other on a diagonal, or seeds overlap to a longer one, an anchor there is
extended to both sides. Extensions of a batch go on together, row by row, over the band around their diagonals; letters are cut around the
anchors, and extensions that are still alive at a cut are done again with longer pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .homology import LAMBDA, PART, SENT, K, seed_kmers
from .seq import kmers
from .staging import staged

#: Scores of equal and different letters, and costs of a gap and of each letter of it, to which LAMBDA and K belong.
MATCH, MISMATCH, OPEN, EXTEND = 1, -2, 2, 2
#: Diagonals on either side of an anchor's, letters on either side of it that are cut at first, and the drop that ends an extension.
BAND, REACH, DROP = 32, 512, 20
#: Seeds whose triplets repeat so much are of low complexity: pairs of equal triplets over triplets less one.
DUST = 1.0
_NONE = -(1 << 20)


def low_complexity(kmer: str = "kmer", k: int = 11, most: float = DUST, n_counts: bool = False):
    """Whether a k-mer holds an N, unless N counts as a letter, or repeats its triplets: the share of pairs of equal ones, scaled as DUST scores are."""
    three = [F.substring(kmer, i + 1, 3) for i in range(k - 2)]
    pairs = sum(((three[i] == three[j]).cast("int") for i in range(k - 2) for j in range(i)), F.lit(0))
    return (F.col(kmer).contains("N") & F.lit(not n_counts)) | (pairs / (k - 3) > most)


def masked_regions(df: DataFrame, k: int = 11) -> DataFrame:
    """seq_id, start and end (from 0, end exclusive) of the maximal runs under low-complexity k-mers of sequences(seq_id, seq): the
    soft mask, as labels."""
    low = kmers(df.select("seq_id", "seq"), k).filter(low_complexity("kmer", k)).select("seq_id", "pos")
    w = Window.partitionBy("seq_id").orderBy("pos")
    new = F.coalesce(F.col("pos") > F.lag("pos").over(w) + k, F.lit(True)).cast("int")
    return low.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("seq_id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("end")).drop("run")


def extend(qs: list[bytes], ss: list[bytes], drop: int = DROP, band: int = BAND) -> list[tuple[int, int, int, int, int, int, int, bool]]:
    """For each pair the best alignment of a beginning of q with one of s: score, letters of q and of s, equal letters,
    different ones, gaps, letters in gaps; and whether the extension was alive at an end of q or s.

    Alignments stay within band diagonals and are given up where they fall drop below the best score so far.
    """
    n, width = len(qs), 2 * band + 1
    q_len, s_len = np.array([len(x) for x in qs]), np.array([len(x) for x in ss])
    rows = int(q_len.max(initial=0))
    q = np.full((n, rows + 1), 254, np.uint8)
    s = np.full((n, rows + width + 1), 255, np.uint8)
    for i, (x, y) in enumerate(zip(qs, ss, strict=True)):
        q[i, : len(x)] = np.frombuffer(x, np.uint8)
        y = y[: rows + band]
        s[i, band : band + len(y)] = np.frombuffer(y, np.uint8)
    at = np.arange(width)
    h = np.where(at >= band, -np.where(at > band, OPEN + EXTEND * (at - band), 0), _NONE) + np.zeros((n, 1), np.int64)
    h[(h < -drop) | (at - band > s_len[:, None])] = _NONE
    f = np.full((n, width), _NONE, np.int64)
    best, best_i, best_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, band)
    alive = np.ones(n, bool)
    touched = ((h > _NONE) & (at - band == s_len[:, None])).any(axis=1) | (q_len == 0)
    moves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nothing = np.full((n, 1), _NONE, np.int64)
    for i in range(1, rows + 1):
        same = q[:, i - 1, None] == s[:, i - 1 : i - 1 + width]
        d = h + np.where(same, MATCH, MISMATCH)
        opened, longer = np.hstack([h[:, 1:], nothing]) - OPEN - EXTEND, np.hstack([f[:, 1:], nothing]) - EXTEND
        f = np.maximum(opened, longer)
        ok = alive[:, None] & (i <= q_len[:, None]) & (i + at - band >= 0) & (i + at - band <= s_len[:, None])
        d[(i + at - band < 1)[None, :] & np.ones((n, 1), bool)] = _NONE
        base = np.where(ok, np.maximum(d, f), _NONE)
        # the best cell to the left from which a gap leads here
        lead = np.maximum.accumulate((base + EXTEND * at) * 128 + at, axis=1)
        lead = np.hstack([np.full((n, 1), _NONE * 128), lead[:, :-1]])
        e, size = (lead >> 7) - OPEN - EXTEND * at, at - (lead & 127)
        h = np.where(ok, np.maximum(base, e), _NONE)
        top = h.max(axis=1)
        better = top > best
        best[better], best_i[better], best_b[better] = top[better], i, h[better].argmax(axis=1)
        h[h < best[:, None] - drop] = _NONE
        f[(f < best[:, None] - drop) | ~ok] = _NONE
        moves.append((np.where(h == base, np.where(base == d, 0, 1), 2).astype(np.uint8), (longer > opened).astype(np.uint8), size.astype(np.uint8)))
        live = h > _NONE
        touched |= live.any(axis=1) & (i == q_len) | (live & (i + at - band == s_len[:, None])).any(axis=1)
        alive &= live.any(axis=1)
        if not alive.any():
            break
    out = []
    for k in range(n):
        i, b = int(best_i[k]), int(best_b[k])
        equal = different = gaps = letters = 0
        while i:
            move, longer, size = (x[k, b] for x in moves[i - 1])
            if move == 0:
                equal, different = (equal + 1, different) if q[k, i - 1] == s[k, i - 1 + b] else (equal, different + 1)
                i -= 1
            elif move == 2:
                gaps, letters, b = gaps + 1, letters + int(size), b - int(size)
            else:
                gaps += 1
                while True:
                    longer = moves[i - 1][1][k, b]
                    i, b, letters = i - 1, b + 1, letters + 1
                    if not longer:
                        break
        if b > band:
            gaps, letters = gaps + 1, letters + b - band
        out.append((int(best[k]), int(best_i[k]), int(best_i[k] + best_b[k] - band), equal, different, gaps, letters, bool(touched[k])))
    return out


_FOUND = "q_from long, q_to long, s_from long, s_to long, score long, equal long, different long, gaps long, letters long, alive boolean"


def _extended(batches: Iterator[pa.RecordBatch], keep: list[str], most: int = 128) -> Iterator[pa.RecordBatch]:
    """Anchors (qa, sa) with pieces q and s that begin at q0 and s0, and whether each piece is cut at either end."""
    for batch in batches:
        for k in range(0, len(batch), most):
            b = batch.slice(k, most)
            c = {n: b.column(n).to_pylist() for n in ("q", "s", "q0", "s0", "qa", "sa", "cut_left", "cut_right")}
            rows = range(len(b))
            q, s = ([x.encode() for x in c[n]] for n in ("q", "s"))
            qa, sa = ([c[f"{n}a"][i] - c[f"{n}0"][i] for i in rows] for n in ("q", "s"))
            right = extend([q[i][qa[i] :] for i in rows], [s[i][sa[i] :] for i in rows])
            left = extend([q[i][: qa[i]][::-1] for i in rows], [s[i][: sa[i]][::-1] for i in rows])
            out = [(c["qa"][i] - x[1], c["qa"][i] + y[1], c["sa"][i] - x[2], c["sa"][i] + y[2], *(x[j] + y[j] for j in (0, 3, 4, 5, 6)), x[7] and c["cut_left"][i] or y[7] and c["cut_right"][i]) for i, x, y in zip(rows, left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *(pa.array(x) for x in zip(*out, strict=True))], names=[*keep, *(x.split()[0] for x in _FOUND.split(", "))])


def anchors(queries: DataFrame, strands: DataFrame, word: int, apart: int, single: int, n_counts: bool = False) -> DataFrame:
    """One place (seq_id, ref_id, strand, qa, sa) for each run of seeds on a diagonal in which two that don't overlap begin at most apart
    letters from each other, or that has single equal letters in a row."""
    db = kmers(strands, word).withColumnRenamed("pos", "s_pos").filter(~low_complexity("kmer", word, n_counts=n_counts))
    frequent = db.groupBy("kmer").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts")).filter("_parts > 1")
    db = db.join(frequent, "kmer", "left").withColumn("_salt", F.pmod(F.xxhash64("ref_id", "strand", "s_pos"), F.coalesce("_parts", F.lit(1))).cast("int"))
    small = strands.agg(F.coalesce(F.sum(F.greatest(F.length("seq") - word + 1, F.lit(0))), F.lit(0))).first()[0] <= SENT
    sent = F.broadcast if small else lambda x: x
    own = queries.select("seq_id", "seq")
    found = (seed_kmers(own, db, word) if small else kmers(own, word)).join(sent(frequent), "kmer", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    seeds = found.join(sent(db), ["kmer", "_salt"]).select("seq_id", "ref_id", "strand", "pos", (F.col("pos") - F.col("s_pos")).alias("diag"))
    w = Window.partitionBy("seq_id", "ref_id", "strand", "diag").orderBy("pos")
    second = (F.count(F.lit(1)).over(w.rangeBetween(-apart, -word)) > 0) | (F.count(F.lit(1)).over(w.rangeBetween(word - single, 0)) == single - word + 1)
    runs = seeds.withColumns({"second": second, "new": F.coalesce(F.col("pos") - F.lag("pos").over(w) > apart, F.lit(True)).cast("int")})
    runs = runs.withColumn("run", F.sum("new").over(w)).groupBy("seq_id", "ref_id", "strand", "diag", "run").agg(F.min(F.when(F.col("second"), F.col("pos"))).alias("qa")).filter("qa IS NOT NULL")
    return runs.select("seq_id", "ref_id", "strand", "qa", (F.col("qa") - F.col("diag")).alias("sa"))


def gapped_hits(queries: DataFrame, refs: DataFrame, word: int = 11, apart: int = 40, single: int = 16, evalue: float = 1e-5, reach: int = REACH, n_counts: bool = False) -> DataFrame:
    """Twelve-column hits of queries(seq_id, seq) in refs(ref_id, seq), both strands, 1-based inclusive coordinates; s_start > s_end on
    the minus strand.

    A hit is the best alignment through an anchor, of those that begin or end at the same letters the best one. Letters score
    +1 if equal and -2 if not, a gap of k letters costs 2 + 2k; gaps shift an alignment by at most BAND letters from its
    anchor's diagonal. Evalues follow Karlin and Altschul over the query's and all references' letters. References of one text are
    searched as one; a null sequence has no hits, a null ref_id is no reference; repeated ids are searched each. Empty tables
    give no row. reach is how many letters are cut around an anchor at first; it changes no result. n_counts: N is a letter like
    others, as in texts that aren't of nucleotides; else seeds that hold it start nothing.
    """
    refs = refs.filter("ref_id IS NOT NULL AND seq IS NOT NULL").select("ref_id", "seq")
    texts = refs.groupBy("seq").agg(F.min("ref_id").alias("_text"))
    members = refs.join(texts, "seq").select("_text", "ref_id")
    one = texts.select(F.col("_text").alias("ref_id"), "seq")
    strands = one.select("ref_id", F.lit("+").alias("strand"), "seq").unionAll(one.select("ref_id", F.lit("-").alias("strand"), T.reverse_complement("seq").alias("seq")))
    # rows of one seq_id may differ in their sequence: each is a query of its own until the end
    own = queries.filter("seq IS NOT NULL").select("seq_id", "seq")
    numbered = staged(own.withColumn("_no", F.monotonically_increasing_id()), "queries")
    open_ = staged(anchors(numbered.select(F.col("_no").alias("seq_id"), "seq"), strands, word, apart, single, n_counts), "anchors")
    q, s = numbered.select(F.col("_no").alias("seq_id"), F.col("seq").alias("q_seq")), strands.select("ref_id", "strand", F.col("seq").alias("s_seq"))
    keep = ["seq_id", "ref_id", "strand", "qa", "sa", "q_len", "s_len"]
    kind = dict(strands.dtypes)["ref_id"]
    schema = f"seq_id long, ref_id {kind}, strand string, qa long, sa long, q_len long, s_len long, {_FOUND}"
    done: DataFrame | None = None
    while True:
        both = open_.join(q, "seq_id").join(s, ["ref_id", "strand"])
        cut = {"q": ("q_seq", "qa", reach), "s": ("s_seq", "sa", reach + BAND)}
        for name, (col, at, n) in cut.items():
            both = both.withColumns({f"{name}0": F.greatest(F.col(at) - n, F.lit(0)), f"{name}_len": F.length(col).cast("long")})
            both = both.withColumn(name, F.substring(F.col(col), (F.col(f"{name}0") + 1).cast("int"), (F.col(at) + n - F.col(f"{name}0")).cast("int")))
        both = both.withColumns({"cut_left": F.col("q0") + F.col("s0") > 0, "cut_right": (F.col("qa") + reach < F.col("q_len")) | (F.col("sa") + reach + BAND < F.col("s_len"))})
        found = staged(both.select(*keep, "q", "s", "q0", "s0", "cut_left", "cut_right").mapInArrow(lambda b: _extended(b, keep), schema), "extended")
        done = found.filter("NOT alive") if done is None else done.unionAll(found.filter("NOT alive"))
        open_ = found.filter("alive").select(*keep[:5])
        if open_.isEmpty():
            break
        reach *= 4
    for ends in (("q_from", "s_from"), ("q_to", "s_to")):
        w = Window.partitionBy("seq_id", "ref_id", "strand", *ends).orderBy(F.desc("score"), F.col("q_to") - F.col("q_from"), "q_from", "s_to", "s_from", "gaps", "letters", "qa")
        done = done.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")
    total = refs.agg(F.sum(F.length("seq")).alias("db_len"))
    scored = done.crossJoin(F.broadcast(total)).withColumns({"n": F.col("equal") + F.col("different") + F.col("letters"), "e": K * F.col("q_len") * F.col("db_len") * F.exp(-LAMBDA * F.col("score"))}).filter(F.col("e") <= evalue)
    plus = F.col("strand") == "+"
    named = scored.withColumnRenamed("ref_id", "_text").join(members, "_text").join(numbered.select(F.col("_no").alias("_q"), F.col("seq_id").alias("query_id")), F.col("seq_id") == F.col("_q"))
    return named.select(
        "query_id", F.col("ref_id").alias("subject_id"), (F.col("equal") / F.col("n") * 100).alias("percent_identity"), F.col("n").alias("alignment_length"), F.col("different").alias("mismatches"), F.col("gaps").alias("gap_opens"),
        (F.col("q_from") + 1).alias("q_start"), F.col("q_to").alias("q_end"), F.when(plus, F.col("s_from") + 1).otherwise(F.col("s_len") - F.col("s_from")).alias("s_start"), F.when(plus, F.col("s_to")).otherwise(F.col("s_len") + 1 - F.col("s_to")).alias("s_end"),
        F.col("e").alias("evalue"), ((LAMBDA * F.col("score") - math.log(K)) / math.log(2)).alias("bit_score"),
    )
