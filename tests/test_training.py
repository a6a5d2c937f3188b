import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from strandsieve.operators import anomaly, features, motif, seq, tfidf, training


def fragments(spark, n=60, seed=1, changed=None):
    """Fragments of records of three classes that differ in their letters."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = 0 if i % 6 < 4 else i % 6 - 3
        weights = {0: (4, 4, 2, 2), 1: (2, 2, 4, 4), 2: (1, 5, 5, 1)}[label]
        for k in range(2):
            rows.append((i, label, k, "".join(rng.choices("ATGC", weights, k=120))))
    if changed is not None:
        rows = [(i, y, k, "ATTTAGGCN" * 12 if i == changed else x) for i, y, k, x in rows]
    return spark.createDataFrame(rows, "seq_id long, label int, idx long, frag string")


def test_vectors_are_the_weights_of_the_tables(spark):
    frags = fragments(spark, 12).unionByName(spark.createDataFrame([(100, 0, 0, ""), (101, 0, 0, "ATG"), (102, 0, 0, "ATGCATGC")], "seq_id long, label int, idx long, frag string"))
    by = ("seq_id", "idx")
    counts = features.term_counts(frags, by)
    want = {}
    for r in features.tfidf(counts, features.vocabulary(counts, 3, 500), frags.count(), by).collect():
        want.setdefault((r.seq_id, r.idx), {})[r.token] = r.weight
    model = tfidf.SublinearTfidf(minDF=3, vocabSize=500).fit(frags)
    terms = model.getOrDefault("vocabulary")
    assert len(terms) == 500
    for r in model.transform(frags.withColumn("extra", F.lit(1))).collect():
        own = {terms[i]: v for i, v in zip(r.tfidf.indices, r.tfidf.values, strict=True)}
        assert own.keys() == want.get((r.seq_id, r.idx), {}).keys() and r.extra == 1
        assert all(abs(own[t] - w) < 1e-12 for t, w in want.get((r.seq_id, r.idx), {}).items())


def test_models_are_saved_in_a_pipeline(spark, tmp_path):
    frags = fragments(spark, 12).withColumn("gc", F.lit(0.5))
    model = Pipeline(stages=[tfidf.SublinearTfidf(vocabSize=100), VectorAssembler(inputCols=["tfidf", "gc"], outputCol="features")]).fit(frags)
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    rows = lambda m: [r.features for r in m.transform(frags).orderBy("seq_id", "idx").collect()]
    assert rows(again) == rows(model) and rows(model)[0].size == 101


def sparse_rows(spark, n, size=400, seed=3):
    rng = np.random.default_rng(seed)
    centres = [(rng.choice(size, 30, False), rng.random(30)) for _ in range(25)]
    rows = []
    for i in range(n):
        at, v = centres[i % 25]
        keep = rng.random(30) < 0.8
        more = rng.choice(size, 3, False)
        x = np.zeros(size)
        x[at[keep]] = v[keep]
        x[more] += 0.3 * rng.random(3)
        rows.append((i, Vectors.sparse(size, {int(j): float(x[j]) for j in np.flatnonzero(x)})))
    return rows, spark.createDataFrame(rows, ["row", "features"])


def test_recall_of_neighbours(spark):
    rows, df = sparse_rows(spark, 1500)
    x = np.stack([v.toArray() for _, v in rows])
    apart = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0)
    np.fill_diagonal(apart, np.inf)
    true = np.argsort(apart, axis=1)[:, :3]
    found = {}
    for r in training.near_rows(df, 400, 1500).collect():
        assert abs(r.distance - np.sqrt(apart[r.row, r.other])) < 1e-6
        found.setdefault(r.row, set()).add(r.other)
    hit = sum(len(found[i] & set(true[i].tolist())) for i in range(1500))
    assert training._bits(1500) > 3 and hit >= 0.9 * 4500
    few = training.near_rows(df.limit(20), 400, 20)  # no bits: exact
    assert few.groupBy("row").count().filter("count <> 3").isEmpty()


def test_oversampling_lies_between_neighbours(spark):
    rows, df = sparse_rows(spark, 200)
    df = df.withColumn("label", F.when(F.col("row") < 130, 0).when(F.col("row") < 197, 1).otherwise(2))
    got = training.smote_vectors(df).collect()
    n = {}
    for r in got:
        n[r.label] = n.get(r.label, 0) + 1
    assert n == {0: 130, 1: 130, 2: 3}  # three rows of class 2 have no three neighbours
    x = np.stack([v.toArray() for _, v in rows])
    own = x[130:197]
    apart = np.linalg.norm(own[:, None] - own, axis=2)
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1)[:, :3]
    for r in got:
        if r.row < 0:
            i, v = (-r.row - 1) // 1_000_000 - 130, r.features.toArray()
            ends = [own[j] for j in near[i]]
            assert min(np.linalg.norm(v - own[i]) + np.linalg.norm(z - v) - np.linalg.norm(z - own[i]) for z in ends) < 1e-9
    assert not training.smote_vectors(df.limit(0)).collect()


@pytest.fixture(scope="module")
def nested(spark):
    return training.nested_cv(fragments(spark), 3, trees=8, terms=200, envelope_trees=20).collect()


def test_nested_folds(spark, nested):
    assert len(nested) == 120
    folds_ = {}
    for r in nested:
        folds_.setdefault(r.seq_id, set()).add(r.fold)
        assert abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 and abs(r.q0 + r.q1 + r.q2 - 1) < 1e-9
    assert all(len(f) == 1 for f in folds_.values()) and {r.fold for r in nested} == {0, 1, 2}
    scores = {r.fold: r for r in training.nested_scores(spark.createDataFrame(nested)).collect()}
    assert set(scores) == {"Fold 1", "Fold 2", "Fold 3", "Mean", "Std"} and scores["Mean"].auroc > 0.9
    assert abs(scores["Mean"].auroc - np.mean([scores[f"Fold {k}"].auroc for k in (1, 2, 3)])) < 1e-9


def test_no_validation_record_reaches_a_fit(spark):
    fitted = []
    for changed in (None, 5):
        rows = fragments(spark, changed=changed).withColumn("row", F.col("seq_id") * 10 + F.col("idx"))
        m = training.FragmentModel(rows.filter("seq_id % 5 <> 0"), terms=200, trees=5, envelope_trees=10)
        fitted.append((m.tfidf.getOrDefault("vocabulary"), m.tfidf.getOrDefault("idf"), m.scale, tuple(m.anchor), m.background, m.forest.toDebugString.split("\n", 1)[1]))
        assert m.probabilities(rows.filter("seq_id % 5 = 0")).count() == 24
    assert fitted[0] == fitted[1]
    other = training.FragmentModel(fragments(spark, changed=6).withColumn("row", F.col("seq_id") * 10 + F.col("idx")).filter("seq_id % 5 <> 0"), terms=200, trees=5, envelope_trees=10)
    assert other.tfidf.getOrDefault("idf") != fitted[0][1]


def test_fragments_of_sequences_go_in(spark):
    seqs = spark.createDataFrame([(i, i % 3, "ATGCNATT" * (5 + i)) for i in range(9)], "seq_id long, label int, seq string")
    assert tfidf.SublinearTfidf().fit(seq.fragments(seqs)).transform(seq.fragments(seqs)).count() == 9


def test_shapes_are_made_in_place(spark):
    rows = fragments(spark, 12).withColumn("row", F.col("seq_id") * 10 + F.col("idx")).select("row", "label", "frag")
    rows = rows.unionByName(spark.createDataFrame([(500, 0, "ATGCéXATGCATG"), (501, 0, "ATG"), (502, 0, "")], "row long, label int, frag string"))
    m = training.FragmentModel.__new__(training.FragmentModel)
    m.background = ["ATGCATGCNATG", "AT", "", *(r.frag for r in rows.orderBy("row").limit(5).collect())]
    got = m.shaped(rows)
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join"))
    known = spark.createDataFrame(list(enumerate(m.background)), "seq_id long, seq string")
    best = motif.enriched_kmers(rows.select(F.col("row").alias("seq_id"), F.col("frag").alias("seq")), 6, 1, known, len(m.background))
    folds_ = {r.seq_id: r.fold for r in best.collect()}
    vectors = {r.row: r.v for r in anomaly.vector_table(rows.withColumn("idx", F.lit(0)), "row").collect()}
    for r in got.collect():
        assert r.motif == folds_.get(r.row, 0.0) and r.v == vectors[r.row]


def test_rows_of_folds_lie_in_a_part_for_each_core(spark):
    rows = training.fold_rows(fragments(spark), 3, 42)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.select("row").distinct().count() == rows.count() == 120


def test_dense_and_sparse_vectors_are_read(spark):
    rows = [(0, Vectors.sparse(4, {1: 2.0, 3: -1.0})), (1, Vectors.dense([1.0, 0.0, 3.0, 0.5])), (2, Vectors.sparse(4, {})), (3, Vectors.sparse(4, {0: 1.5}))]
    table = spark.createDataFrame(rows, ["row", "features"]).coalesce(1).toArrow()
    indices, values = tfidf.read_vectors(table.column("features"))
    assert [i.tolist() for i in indices] == [[1, 3], [0, 1, 2, 3], [], [0]] and [v.tolist() for v in values] == [[2.0, -1.0], [1.0, 0.0, 3.0, 0.5], [], [1.5]]
