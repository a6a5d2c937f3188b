"""What reviews found, held by small tests."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsieve.operators import anomaly, classify, counted_forest, features, seq, terms
from strandsieve.plans import catalog


def test_calibrated_scores_have_platts_probability_and_anchors_of_fragments(spark, sf_dir, monkeypatch):
    fit = anomaly.fit_forest
    monkeypatch.setattr(anomaly, "fit_forest", lambda vectors, trees=20, **how: fit(vectors, trees=20, **how))
    got = {r.seq_id: r for r in catalog.QUERIES["ood_calibrated"](spark, sf_dir).collect()}
    likely = {r.seq_id: r.p for r in catalog.QUERIES["ood_platt"](spark, sf_dir).collect()}
    assert len(got) > len(likely) > 0 and {i: r.p for i, r in got.items() if r.p is not None} == likely
    vectors, forest = catalog.envelope(spark, sf_dir)
    known = anomaly.raw_scores(vectors, forest).join(catalog.labels(spark, sf_dir), "seq_id")
    means = {r.label: r.raw for r in known.groupBy("label").agg(F.avg("raw").alias("raw")).collect()}
    turn = 1 if means[2] > means[0] else -1
    for r in got.values():
        if r.raw is not None:
            share = (r.raw - means[0]) * turn / abs(means[2] - means[0]) * 100
            # raw comes rounded to six digits
            assert r.score == pytest.approx(min(100, max(0, share)), abs=0.02 + 1e-4 / abs(means[2] - means[0]))


def counted(spark, n=120, size=400, seed=4):
    """Rows of few of many columns, of which column 7 tells the classes."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        columns = sorted({7, *rng.choice(size, 12, False).tolist()})
        rows.append((i, i % 3, columns, [1 + 4 * (i % 3) if c == 7 else int(rng.integers(1, 4)) for c in columns]))
    return rows, spark.createDataFrame(rows, "row long, label int, columns array<int>, counts array<int>").repartition(3)


def test_a_forest_on_many_columns_splits_as_a_plain_one(spark):
    """Rows stay sparse. One tree that may choose among all columns is held against the sums of its rows, made one by one."""
    rows, df = counted(spark)
    weights, size = {0: 1.0, 1: 1.0, 2: 0.5}, 400
    w = counted_forest.drawn(np.arange(len(rows)), 1, 42)[:, 0].astype(int)
    x = np.zeros((len(rows), size), int)
    for i, _, columns, counts in rows:
        x[i, columns] = counts
    y, share = np.array([r[1] for r in rows]), np.array([weights[r[1]] for r in rows])

    def impurity(own):
        total = (w * share)[own].sum()
        return total, 1 - sum(((w * share)[own & (y == c)].sum() / total) ** 2 for c in weights) if total else 0.0

    found = np.zeros(size)

    def grow(own, depth):
        total, here = impurity(own)
        best = None
        for c in range(size):
            for cut in sorted(set(x[own, c]) - {0}):
                left, right = own & (x[:, c] < cut), own & (x[:, c] >= cut)
                if min(w[left].sum(), w[right].sum()) >= 2:
                    (a, p), (b, q) = impurity(left), impurity(right)
                    gain = round(here - (a * p + b * q) / total, 12)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, c, left, right
        if best and depth < 3:
            found[best[1]] += best[0] * total
            grow(best[2], depth + 1)
            grow(best[3], depth + 1)

    grow(w > 0, 0)
    got = counted_forest.importances(df, size, weights, 1, 3, 13.0, width=size)
    assert np.allclose(got, found / found.sum()) and got[7] > 0.9
    many = counted_forest.importances(df, size, weights, 40, 5, 13.0)
    assert many.argmax() == 7 and abs(many.sum() - 1) < 1e-9 and np.count_nonzero(many) > 20
    assert np.allclose(many, counted_forest.importances(df.repartition(7), size, weights, 40, 5, 13.0))


def test_saliency_has_every_position(spark):
    text = "ACGTNACGGTCATTGACCAGT" * 60
    rows = [(1, text), (2, "ACGTACGTA"), (3, "ACGTACG"), (4, ""), (5, "ACGTéACGTACGT"), (6, None)]
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    weights = {"k8_ACGTACGT": -0.25, "k8_" + text[497:505]: 0.5, "k8_" + text[99:107]: 0.125}
    importance = spark.createDataFrame(list(weights.items()), "token string, weight double")
    for piece in (100, 4096):
        got = sorted((r.seq_id, r.pos, r.token, r.weight) for r in features.saliency_track(seqs, importance, piece=piece).collect())
        want = [(i, p, t, abs(weights.get(t, 0.0))) for i, x in rows for p in range(len(x or "") - 7) for t in [f"k8_{x[p : p + 8]}"]]
        assert got == sorted(want)
    # fragments lose what lies across their borders
    frags = seq.tokens(seq.fragments(seqs.filter("seq_id = 1")), (8,))
    assert frags.count() < len(text) - 7


def test_the_query_looks_at_every_position(spark, sf_dir, monkeypatch):
    found = spark.createDataFrame([("k8_TANTATTA", 1.0)], "token string, weight double")
    monkeypatch.setattr(catalog.classify, "token_importances", lambda frags: found)
    seqs = catalog.sequences(spark, sf_dir)
    want = seqs.agg(F.sum(F.greatest(F.length("seq") - 7, F.lit(0)))).first()[0]
    assert catalog.QUERIES["saliency"](spark, sf_dir).select("seq_id", "pos").distinct().count() == want


def test_what_a_fold_has_written_goes(spark, monkeypatch):
    from strandsieve.operators import staging, training
    from tests.test_training import fragments, sparse_rows

    written, put = [], staging.staged

    def noted(df, name):
        out = put(df, name)
        written.append((name, out.inputFiles()[0].removeprefix("file://")))
        return out

    monkeypatch.setattr(training, "staged", noted)
    assert len(training.nested_cv(fragments(spark), 2, trees=3, terms=60, envelope_trees=5).collect()) == 120
    left = {name for name, path in written if os.path.exists(path)}
    assert left == {"nested-fragments", "nested-folds", "nested-fold"}
    assert {"train-shaped", "train-features", "train-even", "coded-rows", "near-rows"} < {name for name, _ in written}
    # a few tables at a time find the same neighbours
    _, df = sparse_rows(spark, 300)
    want = sorted(map(tuple, training.near_rows(df, 400, 300).collect()))
    monkeypatch.setattr(training, "FEW", 10)
    assert sorted(map(tuple, training.near_rows(df, 400, 300).collect())) == want


def test_folds_of_many_fragments_are_fitted_one_at_a_time(spark, monkeypatch):
    from tests.test_training import fragments

    frags, now, most = classify.with_features(fragments(spark)), [], []

    def fit(train):
        now.append(1)
        most.append(len(now))
        model = classify.fit_logistic(train, 16, 2, 1, (4,))
        now.pop()
        return model

    # few fragments: several folds at a time, with the same result
    want = sorted(map(tuple, classify.cross_validate(frags, 3, fit).collect()))
    assert max(most) > 1
    most.clear()
    monkeypatch.setattr(classify, "MANY", 100)
    assert sorted(map(tuple, classify.cross_validate(frags, 3, fit).collect())) == want and len(want) == 60
    assert most == [1, 1, 1]


def test_a_forest_weighs_its_rows_once_and_holds_little(spark, monkeypatch):
    from tests.test_training import fragments

    written, put = {}, classify.staged

    def noted(df, name):
        out = put(df, name)
        written[name] = out.inputFiles()[0].removeprefix("file://")
        return out

    monkeypatch.setattr(classify, "staged", noted)
    frags = classify.with_features(fragments(spark))
    model = classify.fit_forest(frags, trees=3, terms=50, depth=4)
    assert model.stages[-1].getMaxMemoryInMB() <= 128 and model.stages[-1].getNumTrees == 3
    # what the forest reads is a table of vectors, which goes after the fit
    assert set(written) == {"forest-rows", "forest-features"} and not any(map(os.path.exists, written.values()))
    found = classify.fragment_probabilities(model, frags).select("p").collect()
    assert len(found) == 120 and all(abs(sum(r.p) - 1) < 1e-9 for r in found)


def test_windows_are_scored_without_vectors_as_with_them(spark):
    from tests.test_training import fragments

    model = classify.fit_logistic(classify.with_features(fragments(spark)), 200, 5)
    odd = ["", "A", "CG", "GCC", "CGCGC", "ACGTéCGG", "NNNNNNNN", "acgtACGT", "GGCCGGCCGGAATT" * 9]
    rows = fragments(spark, 12).select("frag").unionByName(spark.createDataFrame([(x,) for x in odd], "frag string"))
    want = classify.fragment_probabilities(model, classify.with_features(rows)).select("frag", "p").collect()
    got = classify.linear_probabilities(model, rows)
    assert "Assembler" not in str(got._jdf.queryExecution()) and got.columns == ["frag", "p"]
    want, got = sorted((r.frag, r.p) for r in want), sorted((r.frag, r.p) for r in got.collect())
    assert [f for f, _ in got] == [f for f, _ in want] and np.allclose([p for _, p in got], [p for _, p in want], atol=1e-12)
    shares = classify.with_features(rows).collect()
    assert np.allclose(terms.shares([r.frag for r in shares]), [(r.gc, r.cpg, r.gc3) for r in shares], atol=1e-15)
