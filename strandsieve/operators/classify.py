"""Fragment classifiers with Spark ML, calibration, grouped cross-validation and window-size sweeps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import text as T
from . import counted_forest, features, folds, metrics, terms
from .seq import fragments, sliding, whole_fragments
from .staging import staged, unstaged
from .tfidf import LINEAR_TERMS, TERMS, SublinearTfidf

CLASSES = [0, 1, 2]
#: Fragments whose folds are fitted several at a time.
MANY = 500_000
#: What a task of a forest holds for the sums of open nodes, of which it makes several copies: more took no less time.
FOREST_MB = 128


def with_features(frags: DataFrame) -> DataFrame:
    """Adds what the pipelines read beside the fragment: gc, cpg, gc3."""
    return frags.withColumns({"gc": T.gc_share("frag"), "cpg": T.cpg_share("frag"), "gc3": T.gc3_share("frag")})


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = n / (classes x rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = sizes.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(sizes.crossJoin(totals)), label).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def stages(terms: int, min_df: int = 3, ks: tuple[int, ...] = (4, 6, 8)) -> list:
    """Exact TF-IDF weights of the most frequent terms, and scaled dense features, in one vector."""
    scale = [VectorAssembler(inputCols=["gc", "cpg", "gc3"], outputCol="_dense"), StandardScaler(inputCol="_dense", outputCol="dense", withMean=True)]
    # scales are fitted first, so that no terms are counted for them
    return [*scale, SublinearTfidf(inputCol="frag", outputCol="tfidf", ks=list(ks), minDF=min_df, vocabSize=terms), VectorAssembler(inputCols=["tfidf", "dense"], outputCol="features")]


def fit_forest(train: DataFrame, trees: int = 300, terms: int = TERMS, depth: int = 12, seed: int = 42) -> PipelineModel:
    """A random forest with balanced class weights on the fragments' features."""
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed, labelCol="label", featuresCol="features", maxMemoryInMB=FOREST_MB)
    # read in several passes: written once, in one part for each core, whatever parts the input has; a part hands on all its nodes' sums
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = staged(train.repartition(cores).sortWithinPartitions("frag", "label"), "forest-rows")
    made = Pipeline(stages=stages(terms)).fit(parts)
    # a forest reads its rows four times before it keeps them: weighed once
    ready = staged(made.transform(balanced_weights(parts)).select("label", "weight", "features"), "forest-features")
    forest = rf.fit(ready.coalesce(cores))
    unstaged(train.sparkSession, parts, ready)
    return PipelineModel([*made.stages, forest])


def fit_logistic(train: DataFrame, terms: int = LINEAR_TERMS, iterations: int = 50, min_df: int = 3, ks: tuple[int, ...] = (4, 6, 8)) -> PipelineModel:
    lr = LogisticRegression(family="multinomial", weightCol="weight", maxIter=iterations, regParam=0.01, labelCol="label", featuresCol="features")
    return Pipeline(stages=[*stages(terms, min_df, ks), lr]).fit(balanced_weights(train))


def fragment_probabilities(model: PipelineModel, frags: DataFrame, classes: int = 3) -> DataFrame:
    """Adds p: the three class probabilities; classes the model has not seen are 0."""
    p = vector_to_array("probability")
    return model.transform(frags).withColumn("p", F.array(*(F.coalesce(F.get(p, F.lit(c)), F.lit(0.0)) for c in range(classes))))


def linear_probabilities(model: PipelineModel, frags: DataFrame) -> DataFrame:
    """fragment_probabilities() of a model by fit_logistic(): shares and terms are counted, weighed and added up in the same batches, and no vector is made."""
    scaler, tfidf, regression = model.stages[1], model.stages[2], model.stages[-1]
    known, idf = terms.Vocabulary(terms.Terms(tuple(tfidf.getOrDefault("ks"))), tfidf.getOrDefault("vocabulary")), np.array(tfidf.getOrDefault("idf"))
    by_term, by_dense = np.split(regression.coefficientMatrix.toArray().T, [len(known.names)])
    constant, mean, std = regression.interceptVector.toArray(), scaler.mean.toArray(), scaler.std.toArray()
    by_dense = by_dense / np.where(std > 0, std, np.inf)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = known.open()
        for t, group in terms.whole_groups(batches, (), "frag", terms.SMALL):
            row, column, w = opened.weighted(t, group, "frag", idf)
            margin = constant + (terms.shares(t.column("frag").to_pylist()) - mean) @ by_dense
            margin += np.stack([np.bincount(row, w * coefficients[column], len(t)) for coefficients in by_term.T], axis=1)
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            full = np.zeros((len(t), len(CLASSES)))
            full[:, : p.shape[1]] = p / p.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(np.arange(0, full.size + 1, len(CLASSES), dtype=np.int32), pa.array(full.ravel()))
            b = t.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "p"])

    return frags.mapInArrow(run, StructType([*frags.schema.fields, StructField("p", ArrayType(DoubleType()))]))


def record_probabilities(scored: DataFrame, records: DataFrame, empty: str = "natural", key: str = "seq_id") -> DataFrame:
    """Mean probabilities of each record's fragments. A record without fragments is natural, or of each class alike."""
    mean = scored.groupBy(key).agg(*(F.avg(F.col("p")[c]).alias(f"p{c}") for c in CLASSES))
    other = (1.0, 0.0, 0.0) if empty == "natural" else (1 / 3, 1 / 3, 1 / 3)
    return records.join(mean, key, "left").select(*records.columns, *(F.coalesce(f"p{c}", F.lit(other[c])).alias(f"p{c}") for c in CLASSES))


def isotonic(train: DataFrame, test: DataFrame, y: str = "label") -> DataFrame:
    """test with p0..p2 calibrated class by class on train, then scaled to sum to one."""
    out = test
    for c in CLASSES:
        fitted = IsotonicRegression(featuresCol=f"p{c}", labelCol="_y", predictionCol=f"_q{c}").fit(train.withColumn("_y", (F.col(y) == c).cast("double")))
        out = fitted.transform(out)
    total = sum((F.greatest(F.col(f"_q{c}"), F.lit(0.0)) for c in CLASSES), F.lit(0.0))
    keep = [c for c in test.columns if c not in {f"p{c}" for c in CLASSES}]
    return out.select(*keep, *(F.coalesce(F.greatest(F.col(f"_q{c}"), F.lit(0.0)) / F.nullif(total, F.lit(0.0)), F.lit(1 / 3)).alias(f"p{c}") for c in CLASSES))


def cross_validate(frags: DataFrame, n_folds: int = 5, fit=fit_logistic, seed: int = 42, parallel: int | None = None) -> DataFrame:
    """Out-of-fold record probabilities of frags(seq_id, label, frag, ...): fold, seq_id, label, p0..p2.

    Whole records stand in one fold. The loop over folds is over fits, so many at a time by threads of the driver, as a fit is a row
    of short jobs; the fragments with their folds are written first, as each fit reads them, and so is each fold's result.
    A regression keeps its fragments' vectors, some 16 KB each, in memory and on disk: so three folds at a time where fragments are few, else one.
    """
    assigned = folds.group_folds(frags.select("seq_id", "label"), "seq_id", "label", n_folds, seed).select("seq_id", "fold")
    rows = staged(frags.join(assigned, "seq_id"), "folds")

    def one(f: int) -> DataFrame:
        model = fit(rows.filter(F.col("fold") != f))
        test = rows.filter(F.col("fold") == f)
        part = record_probabilities(fragment_probabilities(model, test), test.select("fold", "seq_id", "label").distinct())
        out = staged(part.withColumns({f"p{c}": F.round(f"p{c}", 6) for c in CLASSES}), "out-of-fold")
        unstaged(rows.sparkSession)
        return out

    parallel = parallel or (3 if rows.count() <= MANY else 1)
    with ThreadPool(parallel) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(one), range(n_folds))
    unstaged(rows.sparkSession, rows)
    return reduce(DataFrame.unionByName, parts)


def calibrated_folds(oof: DataFrame, n_folds: int = 5) -> DataFrame:
    """Out-of-fold probabilities calibrated by isotonic regressions on the other folds."""
    out = None
    for f in range(n_folds):
        part = isotonic(oof.filter(F.col("fold") != f), oof.filter(F.col("fold") == f))
        out = part if out is None else out.unionByName(part)
    return out


def fold_scores(oof: DataFrame) -> DataFrame:
    """fold and macro AUROC, then the rows Mean and Std (population) over folds."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (F.col("label") == c).cast("int").alias("y"), F.col(f"p{c}").alias("x")) for c in CLASSES))).alias("o")
    by = metrics.auroc(oof.select("fold", each).select("fold", "o.class", "o.y", "o.x"), ("fold", "class"))
    macro = by.groupBy("fold").agg(F.avg("auroc").alias("auroc"))
    total = macro.agg(F.avg("auroc").alias("mean"), F.stddev_pop("auroc").alias("std"))
    rows = total.select(F.explode(F.array(F.struct(F.lit("Mean").alias("fold"), F.col("mean").alias("auroc")), F.struct(F.lit("Std").alias("fold"), F.col("std").alias("auroc")))).alias("r")).select("r.*")
    return macro.select(F.concat(F.lit("Fold "), F.col("fold") + 1).alias("fold"), "auroc").unionByName(rows)


def window_sweep(seqs: DataFrame, sizes: tuple[int, ...] = (250, 500, 1000, 2000), per_class: int = 60, n_folds: int = 5, ks: tuple[int, ...] = (4, 6, 8), terms: int = LINEAR_TERMS) -> DataFrame:
    """For each window size: windows, macro AUROC, DeLong's interval of natural against the rest and the mean recalls, out of
    fold, each fold of each size with a vocabulary of its own. A size at which a class has no window is left out.

    Sizes are a few parameters; the records are the first per_class of each class.
    """
    # the records are written once: what follows is bounded, however many there are
    chosen, out = staged(folds.first_per_group(seqs, "label", ["seq_id"], per_class), "window-records"), None
    for size in sizes:
        frags = with_features(whole_fragments(chosen, size))
        if frags.select("label").distinct().count() == len(CLASSES):
            oof = cross_validate(frags, n_folds, lambda t: fit_logistic(t, terms, 1000, 1, ks))
            p = T.argmax(F.array(*(f"p{c}" for c in CLASSES)))
            recalls = metrics.mean_recalls(oof.select("fold", F.col("label").alias("y"), p.alias("p")), "fold", CLASSES).groupBy().pivot("class", CLASSES).agg(F.first("recall"))
            macro = metrics.macro_auroc(oof, CLASSES, {c: f"p{c}" for c in CLASSES})
            ci = metrics.delong(oof.select(F.lit(size).alias("window"), (F.col("label") == 0).cast("int").alias("y"), F.col("p0").alias("x")), ("window",))
            n = frags.agg(F.count(F.lit(1)).alias("n_windows"))
            row = ci.crossJoin(macro).crossJoin(n).crossJoin(recalls).select("window", "n_windows", "macro_auroc", F.col("auroc").alias("auroc_natural"), "lo", "hi", *(F.col(str(c)).alias(f"recall_{c}") for c in CLASSES))
            out = row if out is None else out.unionByName(row)
    if out is None:
        schema = "window int, n_windows long, macro_auroc double, auroc_natural double, lo double, hi double" + "".join(f", recall_{c} double" for c in CLASSES)
        return seqs.sparkSession.createDataFrame([], schema)
    return out


def token_importances(frags: DataFrame, trees: int = 300, k: int = 8, most: int = 100_000, depth: int = 10, seed: int = 42) -> DataFrame:
    """token, weight: the importance of each k-mer of the vocabulary in a random forest on the fragments' k-mer counts.

    The vocabulary is the most frequent k-mers in at least three fragments, so an importance has a token's name. Classes weigh alike.
    """
    own = frags.select("label", "frag")
    names = [r.token for r in features.most_frequent(features.term_statistics(own, ks=(k,), pairs=False, least=3), 3, most).collect()]
    known = terms.Vocabulary(terms.Terms((k,), False), names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = known.open()
        for t, group in terms.whole_groups(batches, (), "frag", terms.SMALL):
            row, column, tf = opened.counted(t, group, "frag")
            ends = np.searchsorted(row, np.arange(len(t) + 1)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (column, np.minimum(tf, counted_forest.BINS - 1)))
            yield pa.RecordBatch.from_arrays([t.column("label").combine_chunks(), *lists], names=["label", "columns", "counts"])

    # read at each level: counted and written once, in one part for each core
    schema = StructType([own.schema["label"], *(StructField(c, ArrayType(IntegerType())) for c in ("columns", "counts"))])
    rows = own.repartition(features.cores(own)).mapInArrow(counted, schema).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows.select("row", "label", "columns", "counts"), "counted-rows")
    sizes = {r.label: (r.n, r.m) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("columns")).alias("m")).collect()}
    n = sum(x for x, _ in sizes.values())
    weights, per_row = {c: n / (len(sizes) * x) for c, (x, _) in sizes.items()}, sum(m for _, m in sizes.values()) / max(1, n)
    found = counted_forest.importances(rows, len(names), weights, trees, depth, per_row, seed) if names else []
    return frags.sparkSession.createDataFrame([(x, float(w)) for x, w in zip(names, found, strict=True) if w > 0], "token string, weight double")


def risk_track(seqs: DataFrame, model: PipelineModel) -> DataFrame:
    """seq_id, x and risk along each record: windows of at least 500 letters in up to 40 steps."""
    n = F.length("seq")
    sized = seqs.withColumn("st", F.greatest(F.lit(50), F.floor(n / 40)).cast("int"))
    sized = sized.withColumn("sp", F.greatest(F.lit(500), F.col("st")))
    cut = sliding(sized, F.col("sp"), F.col("st")).withColumnRenamed("win", "frag")
    scored = linear_probabilities(model, cut.select("seq_id", "start", "frag"))
    return scored.select("seq_id", (F.col("start") + F.floor(F.length("frag") / 2)).alias("x"), F.round((F.col("p")[1] + F.col("p")[2]) * 100, 6).alias("risk"))


def training_fragments(seqs: DataFrame) -> DataFrame:
    """Fragments of labelled sequences with the features of the pipelines."""
    return with_features(fragments(seqs))
