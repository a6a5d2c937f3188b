"""TF-IDF weights, vocabularies, scaling, top tokens and balanced augmentation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import terms
from .ranges import hash_rank, mixed
from .seq import windows


def term_counts(frags: DataFrame, by: tuple[str, ...], ks: tuple[int, ...] = (4, 6, 8), pairs: bool = True) -> DataFrame:
    """by, token, tf of the tokens and, with pairs, their bigrams in document order (k, then position).

    Fragments are dealt out by their key and counted where they are: no token is shuffled, and no row is made for each.
    """
    found = terms.Terms(ks, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in terms.whole_groups(batches, by, "frag", terms.SMALL):
            own, ids, tf, rest = found.counted(t, group, "frag")
            names = pa.concat_arrays([found.names(ids), pa.array([x for _, x in rest], pa.string())])
            yield _by_group(t, by, group, np.append(own, [g for g, _ in rest]), names, np.append(tf, list(rest.values())).astype(np.int64), names=("token", "tf"))

    own = frags.select(*by, "frag")
    return terms.sorted_by(own, by).mapInArrow(run, StructType([*(own.schema[c] for c in by), StructField("token", StringType()), StructField("tf", LongType())]))


def _by_group(t: pa.Table, by: tuple[str, ...], group: np.ndarray, own: np.ndarray, *columns: pa.Array | np.ndarray, names: tuple[str, ...]) -> pa.RecordBatch:
    """The keys of groups, and columns beside them."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    rows = pa.array(first[np.asarray(own, np.int64)])
    keys = [t.column(c).combine_chunks().take(rows) for c in by]
    return pa.RecordBatch.from_arrays([*keys, *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns)], names=[*by, *names])


def cores(frags: DataFrame) -> int:
    """Tasks for work on few letters that takes long: parts by size would be too few."""
    return frags.sparkSession.sparkContext.defaultParallelism


def term_statistics(frags: DataFrame, by: tuple[str, ...] = (), ks: tuple[int, ...] = (4, 6, 8), pairs: bool = True, least: int = 1, most: int = 1 << 21) -> DataFrame:
    """token, df, n: in how many fragments each term stands (at least so many), and how often. Rows of one key are one fragment; without
    a key each row is.

    Terms are counted in the tasks that read the fragments. A task holds a number for each term of one k-mer, of which there may be
    four million, and about most of the others, and hands on what it has when there are more.
    """
    found = terms.Terms(ks, pairs)
    dense = found.near if found.plain and found.near <= 1 << 22 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, held, rest = np.zeros((2, dense), np.int64), [], 0, {}

        def numbered(ids: np.ndarray, df: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(ids), 1 << 16):
                own = [pa.array(x[a : a + (1 << 16)]) for x in (ids, df, n)]
                yield pa.RecordBatch.from_arrays([own[0], pa.nulls(len(own[0]), pa.string()), *own[1:]], names=["id", "token", "df", "n"])

        def others() -> pa.RecordBatch:
            counts = [pa.array([v[i] for v in rest.values()], pa.int64()) for i in range(2)]
            return pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.array(list(rest), pa.string()), *counts], names=["id", "token", "df", "n"])

        for t, group in terms.whole_groups(batches, by, "frag", terms.SMALL):
            _, ids, tf, odd = found.counted(t, group, "frag")
            low = ids < dense
            if low.any():
                np.add.at(near[0], ids[low], 1)
                np.add.at(near[1], ids[low], tf[low])
            far.append(terms.summed(ids[~low], np.ones(int((~low).sum()), np.int64), tf[~low]))
            held += len(far[-1][0])
            for (_, x), n in odd.items():
                df, all_ = rest.get(x, (0, 0))
                rest[x] = df + 1, all_ + n
            if held > 2 * most:
                far = [terms.summed(*map(np.concatenate, zip(*far, strict=True)))]
                held = len(far[0][0])
                if held > most:
                    yield from numbered(*far[0])
                    far, held = [], 0
            if len(rest) > most // 4:
                yield others()
                rest = {}
        at = np.flatnonzero(near[0])
        yield from numbered(at, *near[:, at])
        if far:
            yield from numbered(*terms.summed(*map(np.concatenate, zip(*far, strict=True))))
        if rest:
            yield others()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id")
            names = found.names(ids.drop_null().to_numpy())
            place = pc.subtract(pc.cumulative_sum(pc.cast(ids.is_valid(), pa.int64())), 1)
            token = pc.if_else(ids.is_valid(), names.take(pc.if_else(ids.is_valid(), place, None)), b.column("token"))
            yield pa.RecordBatch.from_arrays([token, b.column("df"), b.column("n")], names=["token", "df", "n"])

    made = terms.sorted_by(frags.select(*by, "frag"), by, cores(frags)).mapInArrow(run, "id long, token string, df long, n long")
    summed = made.groupBy("id", "token").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= least)
    return summed.mapInArrow(named, "token string, df long, n long")


def vocabulary(counts: DataFrame, min_df: int = 3, most: int = 100_000) -> DataFrame:
    """token, df: the most frequent tokens in at least min_df fragments; equals in order of the token."""
    return most_frequent(counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")), min_df, most)


def most_frequent(statistics: DataFrame, min_df: int = 3, most: int = 100_000) -> DataFrame:
    """The vocabulary by term_statistics."""
    return statistics.filter(F.col("df") >= min_df).orderBy(F.desc("n"), "token").limit(most).select("token", "df")


def weights(frags: DataFrame, by: tuple[str, ...], vocab: DataFrame, n_docs: int, ks: tuple[int, ...] = (4, 6, 8), pairs: bool = True, top: int | None = None, digits: int | None = None) -> DataFrame:
    """by, token, weight, as tfidf() of term_counts() gives them: made where the fragments are, with the vocabulary (at most its limit of
    rows) in each task. With top only the largest of each fragment come out, as by top_tokens(), and their rank.

    Weights are rounded to digits, if given, before they are ranked.
    """
    rows = vocab.collect()
    known = terms.Vocabulary(terms.Terms(ks, pairs), [r.token for r in rows])
    idf = np.log((1 + n_docs) / (1 + np.array([r.df for r in rows], np.float64))) + 1
    place = np.empty(len(rows), np.int64)
    place[sorted(range(len(rows)), key=lambda i: known.names[i])] = np.arange(len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, words = known.open(), pa.array(known.names, pa.string())
        for t, group in terms.whole_groups(batches, by, "frag", terms.SMALL):
            own, column, w = opened.weighted(t, group, "frag", idf)
            if digits is not None:
                w = np.floor(w * 10**digits + 0.5) / 10**digits
            rank = ()
            if top is not None:
                keep = largest(own, w, top)
                own, column, w = own[keep], column[keep], w[keep]
                order = np.lexsort((place[column], -w, own))
                own, column, w = own[order], column[order], w[order]
                _, starts = terms.runs(own)
                number = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own)))) + 1
                keep = number <= top
                own, column, w, rank = own[keep], column[keep], w[keep], (number[keep].astype(np.int32),)
            for a in range(0, len(own), 1 << 17):
                z = a + (1 << 17)
                yield _by_group(t, by, group, own[a:z], words.take(pa.array(column[a:z])), w[a:z], *(r[a:z] for r in rank), names=("token", "weight", *(["rank"] if rank else [])))

    own = frags.select(*by, "frag")
    out = [*(own.schema[c] for c in by), StructField("token", StringType()), StructField("weight", DoubleType())]
    return terms.sorted_by(own, by, cores(frags)).mapInArrow(run, StructType(out + [StructField("rank", IntegerType())] * (top is not None)))


def largest(own: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Which of w are among the n largest distinct ones of their group; groups stand together. They hold the n first in any order of equals."""
    _, starts = terms.runs(own)
    sizes, left = np.diff(np.append(starts, len(own))), w.astype(np.float64)
    least = np.full(len(starts), -np.inf)
    for _ in range(n if len(starts) else 0):
        least = np.maximum.reduceat(left, starts)
        left[left >= np.repeat(least, sizes)] = -np.inf
    return w >= np.repeat(least, sizes)


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: int, by: tuple[str, ...]) -> DataFrame:
    """by, token, weight: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1."""
    w = (1 + F.log("tf")) * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1)
    raw = counts.join(vocab, "token").select(*by, "token", w.alias("w"))
    norm = raw.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, list(by)).select(*by, "token", (F.col("w") / F.col("norm")).alias("weight"))


def top_tokens(weights: DataFrame, by: tuple[str, ...], n: int = 5) -> DataFrame:
    """The n largest weights of each row with their rank; equals in order of the token."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col("weight"))), "token")
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def saliency(toks: DataFrame, importance: DataFrame) -> DataFrame:
    """Adds weight to tokens: their importance (token, weight), 0 where there is none."""
    # a vocabulary of importances is sent to the tokens, which stay where they are made
    return toks.join(F.broadcast(importance.select("token", F.abs("weight").alias("weight"))), "token", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def saliency_track(seqs: DataFrame, importance: DataFrame, k: int = 8, piece: int = 4096) -> DataFrame:
    """token, seq_id, pos and weight of the k-mer at every position of seqs(seq_id, seq): its importance(token, weight), 0 where there is none.

    Records are cut into pieces that overlap by k - 1 letters, so each position is in one piece, and no k-mer is lost at a border.
    """
    rows = importance.collect()
    known, weight = terms.Vocabulary(terms.Terms((k,), False), [r.token for r in rows]), np.append(np.abs([r.weight for r in rows]), 0.0)
    pieces = windows(seqs.select("seq_id", "seq"), F.ceil((F.length("seq") - (k - 1)) / piece), piece + k - 1, piece, out="frag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, head = known.open(), np.frombuffer(f"k{k}_".encode(), np.uint8)
        for t, _ in terms.whole_groups(batches, (), "frag", (1 << 17, terms.ROWS)):
            (row, ids), _, odd = opened.terms.of(t.column("frag"))
            first = np.searchsorted(row, np.arange(len(t)))
            letters = terms.spelled(ids, k)
            token = [terms.strings(np.concatenate([np.broadcast_to(head, (len(ids), len(head))), letters], axis=1))]
            own, pos, w = [row], [np.arange(len(row)) - first[row]], [weight[opened.column(ids)]]
            for i, x in odd:
                names = opened.terms.strings_of(x)
                token.append(pa.array(names, pa.string()))
                own.append(np.full(len(names), i))
                pos.append(np.arange(len(names)))
                w.append(weight[[opened.named.get(n, -1) for n in names]])
            own, pos, w = (np.concatenate(x) for x in (own, pos, w))
            at = pa.array(own.astype(np.int64))
            pos = pos + t.column("start").to_numpy()[own]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(token), t.column("seq_id").combine_chunks().take(at), pa.array(pos.astype(np.int64)), pa.array(w.astype(np.float64))], names=["token", "seq_id", "pos", "weight"])

    made = StructType([StructField("token", StringType()), seqs.schema["seq_id"], StructField("pos", LongType()), StructField("weight", DoubleType())])
    return pieces.select("seq_id", "start", "frag").repartition(cores(seqs)).mapInArrow(run, made)


def anomalous_dimensions(vectors: DataFrame, by: tuple[str, ...], dims: int = 256, n: int = 5) -> DataFrame:
    """The n dimensions furthest from the mean of all dims frequencies; absent ones are 0, so the mean is 1 / dims, and
    only those present can be as far off as the farthest."""
    dev = F.abs(F.col("freq") - 1.0 / dims)
    w = Window.partitionBy(*by).orderBy(F.desc("dev"), "kmer")
    return vectors.withColumn("dev", dev).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def scaled(df: DataFrame, cols: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """cols with mean 0 and population deviation 1 of fitted_on; constant columns become 0."""
    base = df if fitted_on is None else fitted_on
    stats = base.agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    return out.select(*[c for c in df.columns if c not in cols], *(F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols))


def smote(df: DataFrame, key: str, label: str, cols: list[str], k: int = 3, bucket: float = 1.0, seed: int = 42, most: int = 512) -> DataFrame:
    """df(key, label, cols) with synthetic rows of smaller classes until all classes are of one size.

    A synthetic row lies between a row and one of its k nearest rows of the class, by the distance of the scaled columns,
    among those of its own and the neighbouring buckets of a random projection; buckets of more than about most rows are
    cut at random, so no task holds more than three times that. A row without a neighbour is repeated. Classes that have
    no more than k rows are left alone.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    need = sizes.crossJoin(F.broadcast(sizes.agg(F.max("_c").alias("_most")))).filter((F.col("_c") < F.col("_most")) & (F.col("_c") > k)).select(label, "_c", (F.col("_most") - F.col("_c")).alias("_need"))
    ranked = hash_rank(df.select(key, label, *cols).join(F.broadcast(need), label), (label,), key, seed, name="_r")
    # a few unit directions that the seed fixes; the position along their sum names the bucket
    ends = ranked.groupBy(label).agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    units = {c: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-9)) for c in cols}
    weights = [1.0 - 2 * ((seed * 7919 + i * 104729) % 1000) / 1000 for i in range(len(cols))]
    norm = sum(w * w for w in weights) ** 0.5 or 1.0
    along = sum((F.lit(w / norm) * u for w, u in zip(weights, units.values(), strict=True)), F.lit(0.0))
    at = ranked.join(F.broadcast(ends), label).withColumns({"_u": F.array(*units.values()), "_b": F.floor(along / bucket).cast("long")}).drop(*(f"_{n}_{c}" for c in cols for n in "ms"))
    crowd = at.groupBy(label, "_b").agg(F.ceil(F.count(F.lit(1)) / most).alias("_cuts"))
    at = at.join(crowd, [label, "_b"]).withColumn("_cut", F.pmod(F.xxhash64(key, F.lit(seed)), F.col("_cuts")))
    own = at.filter(F.col("_r") <= F.col("_need")).select(F.col(key).alias("_k"), label, "_u", "_r", "_need", "_c", F.array(*cols).alias("_x"), F.explode(F.array(*(F.col("_b") + d for d in (-1, 0, 1)))).alias("_b"), F.col("_cut").alias("_own"))
    near = own.join(crowd, [label, "_b"]).withColumn("_cut", F.pmod("_own", F.col("_cuts"))).drop("_cuts", "_own")
    other = at.select(label, "_b", "_cut", F.col(key).alias("_o"), F.col("_u").alias("_v"), F.array(*cols).alias("_y"))
    pairs = near.join(other, [label, "_b", "_cut"], "left").withColumn("_d", F.when(F.col("_k") != F.col("_o"), F.aggregate(F.zip_with("_u", "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    w = Window.partitionBy("_k").orderBy(F.col("_d").asc_nulls_last(), "_o")
    best = pairs.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    best = best.groupBy("_k", label, "_r", "_need", "_c", "_x").agg(F.array_sort(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("_d", "_o", "_y")))).alias("_near"))
    out = best.withColumn("_j", F.explode(F.sequence(F.lit(0), (F.floor((F.col("_need") - F.col("_r")) / F.col("_c"))).cast("int"))))
    u = mixed(F.col("_k") * 31 + F.col("_j"), seed)
    pick = F.when(F.size("_near") > 0, F.get("_near", F.pmod(u, F.greatest(F.size("_near"), F.lit(1))).cast("int"))["_y"]).otherwise(F.col("_x"))
    out = out.withColumns({"_t": u / 1_000_003, "_z": pick})
    made = out.select((-F.col("_k") * 1000 - F.col("_j") - 1).alias(key), label, *((F.col("_x")[i] + F.col("_t") * (F.col("_z")[i] - F.col("_x")[i])).alias(c) for i, c in enumerate(cols)))
    return df.select(key, label, *cols).unionByName(made)
