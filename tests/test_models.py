import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsieve.operators import anomaly, classify, features, seq
from strandsieve.sources import fasta


def labelled(spark, n=24):
    r = random.Random(9)
    parts = {0: "ATN", 1: "ATGC", 2: "GGCA"}
    rows = [(i, i % 3, "".join(r.choice(parts[i % 3]) for _ in range(600))) for i in range(n)]
    return spark.createDataFrame(rows, "seq_id long, label int, seq string")


def test_isolation_forest_finds_strange_vectors(spark):
    df = labelled(spark, 60)
    v = anomaly.vector_table(seq.whole_fragments(df.drop("label")))
    lengths = {len(r.v) for r in v.collect()}
    assert lengths == {256}
    natural = v.join(df.filter("label = 1").select("seq_id"), "seq_id")
    forest = anomaly.fit_forest(natural, trees=30)
    scores = anomaly.record_scores(anomaly.raw_scores(v, forest)).join(df.select("seq_id", "label"), "seq_id").groupBy("label").agg(F.avg("raw").alias("raw")).collect()
    by = {r.label: r.raw for r in scores}
    assert by[0] > by[1] and by[2] > by[1]


def test_copies_are_drawn_for_all_trees(spark):
    x = spark.createDataFrame([(i, [1.0 if i % 3 == 0 else i / 2400]) for i in range(1200)], "id long, v array<float>")
    forest = anomaly.fit_forest(x, trees=20)
    # a tree that has copies cuts them off from the others, which end at 0.5
    assert len(forest.nodes) == 20 and all(cut.max() > 0.49 for _, cut, *_ in forest.nodes)


def test_calibration(spark):
    row = spark.createDataFrame([(0.5, 0.0, 0.1, 1.0, 1), (-0.5, 0.0, 0.1, 1.0, -1), (0.0, 0.0, 0.1, None, 1), (0.05, None, None, None, 1)], "raw double, mean double, std double, high double, direction int")
    got = [r.s for r in row.select(anomaly.calibrated(*(F.col(c) for c in ("raw", "mean", "std", "high", "direction"))).alias("s")).collect()]
    assert got == [50.0, 50.0, 50.0, 60.0]


def test_cross_validation_learns(spark):
    frags = classify.training_fragments(labelled(spark))
    oof = classify.cross_validate(frags, 2, lambda t: classify.fit_logistic(t, 128, 20))
    rows = classify.fold_scores(oof).collect()
    assert {r.fold: r.auroc for r in rows}["Mean"] > 0.9 and oof.count() == 24
    assert oof.groupBy("seq_id").count().filter("count > 1").count() == 0


def test_tfidf_rows_have_length_one(spark):
    frags = seq.fragments(labelled(spark, 6).drop("label"))
    tf = features.term_counts(frags, ("seq_id", "idx"), (4,))
    w = features.tfidf(tf, features.vocabulary(tf), frags.count(), ("seq_id", "idx"))
    assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("seq_id", "idx").agg(F.sum(F.col("weight") ** 2).alias("s")).collect())
    assert features.top_tokens(w, ("seq_id", "idx")).groupBy("seq_id", "idx").count().agg(F.max("count")).first()[0] == 5


def test_smote_balances(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), float(i), float(i % 7)) for i in range(100)], "id long, label int, a double, b double")
    got = {r.label: r["count"] for r in features.smote(df, "id", "label", ["a", "b"]).groupBy("label").count().collect()}
    assert got == {0: 90, 1: 90}


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "id int, a double, b double")
    assert sorted((r.id, r.a, r.b) for r in features.scaled(df, ["a", "b"]).collect()) == [(1, -1.0, 0.0), (2, 1.0, 0.0)]


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk line\n>one first record\nATGC\nNNAT\n>two\n\n>three x\r\nGG\r\nCC\r\n")
    (tmp_path / "b.fa").write_text(">four\nATATAT\n")
    got = fasta.read_fasta(spark, str(tmp_path), least=1).collect()
    assert sorted((r.seq_id, r.description, r.seq) for r in got) == [("four", "four", "ATATAT"), ("one", "one first record", "ATGCNNAT"), ("three", "three x", "GGCC")]
    assert fasta.read_fasta(spark, str(tmp_path / "a.fa"), most=2, label=1).count() == 2
    df = fasta.read_fasta(spark, str(tmp_path / "b.fa"))
    fasta.write_fasta(df, f"{tmp_path}/out")
    back = fasta.read_fasta(spark, f"{tmp_path}/out").collect()
    assert [(r.seq_id, r.seq) for r in back] == [("four", "ATATAT")]
    s = {r.source_file.rsplit("/", 1)[1]: r for r in fasta.fasta_stats(fasta.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")])).collect()}
    assert (s["a.fa"].records, s["a.fa"].total_bp, s["b.fa"].max_bp) == (3, 12, 6)


def test_tables(spark, tmp_path):
    (tmp_path / "hits.csv").write_text("q1,s1,99.5,20,0,0,1,20,5,24,1e-9,40.1\n")
    assert fasta.read_hits(spark, str(tmp_path / "hits.csv")).first().percent_identity == 99.5
    (tmp_path / "ids.csv").write_text("x,ID\n1,a\n2,b\n3,a\n")
    assert sorted(r.id for r in fasta.read_hit_ids(spark, str(tmp_path / "ids.csv")).collect()) == ["a", "b"]
    (tmp_path / "p.csv").write_text("id,Tool One\n1,1\n2,0\n")
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "seq_id string")
    got = fasta.read_predictions(spark, str(tmp_path / "p.csv"), ids, {"one": "Tool One", "two": "Absent"}).collect()
    assert sorted((r.seq_id, r.tool, r.pred) for r in got) == [("1", "one", 1), ("2", "one", 0), ("3", "one", 0)]


def test_smote_rows_lie_towards_one_of_the_nearest(spark):
    r = random.Random(3)
    rows = [(i, int(i < 12), r.random(), r.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    made = [x for x in features.smote(df, "id", "label", ["a", "b"], bucket=100.0).collect() if x.id < 0]
    own = {i: (a, b) for i, y, a, b in rows if y == 1}
    spread = [np.std([p[k] for p in own.values()]) for k in (0, 1)]
    assert len(made) == 36
    for x in made:
        k = (-x.id - 1) // 1000
        far = lambda j: sum(((own[k][d] - own[j][d]) / spread[d]) ** 2 for d in (0, 1))
        near = sorted((j for j in own if j != k), key=far)[:3]
        # on the line from its row to one of the three
        t = [((x.a - own[k][0]) / (own[j][0] - own[k][0]), (x.b - own[k][1]) / (own[j][1] - own[k][1])) for j in near]
        assert any(abs(u - v) < 1e-6 and -1e-9 <= u <= 1 for u, v in t)


def test_dual_scores_and_flags(spark):
    lengths = spark.createDataFrame([(1, 100), (2, 10), (3, 100), (4, 100)], "seq_id long, len int")
    one = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "seq_id long, score double")
    other = spark.createDataFrame([(1, 5.0), (2, 6.0)], "seq_id long, score double")
    rows = lambda o: {r.seq_id: (r.score, r.other_score, r.flag) for r in anomaly.dual_scores(one, o, lengths).collect()}
    assert rows(other) == {1: (10.0, 5.0, "DUAL_ENVELOPE"), 2: (20.0, 6.0, "SHORT_FRAGMENT"), 3: (30.0, None, "ERROR"), 4: (None, None, "NOT_READY")}
    assert rows(None)[1] == (10.0, None, "SINGLE_ENVELOPE")


def test_windows_and_sanity(spark):
    df = labelled(spark, 6)
    v = anomaly.window_vectors(df, 300, 100)
    assert sorted((r.seq_id, r.centre, len(r.v)) for r in v.collect()) == [(i, c, 256) for i in range(6) for c in (150, 250, 350, 450)]
    scores = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.2), (3, 2, 0.4), (4, 1, 9.0), (5, 2, -9.0)], "seq_id long, label int, raw double")
    r = anomaly.sanity(scores, first=1).first()
    assert (r.natural, r.strange, r.ok) == (0.1, 0.4, True) and anomaly.sanity(scores.limit(0)).first().ok is False


def test_importances_name_the_telling_tokens(spark):
    rows = [(i, i % 2, ("ACGTACGT" if i % 2 else "TTTTTTTT") + "GATTACAGAT" * 2) for i in range(40)]
    frags = spark.createDataFrame(rows, "seq_id long, label int, frag string")
    found = classify.token_importances(frags, trees=10)
    best = found.orderBy(F.desc("weight")).first().token
    assert best.startswith("k8_") and ("ACGT" in best or "TTTT" in best)
    toks = seq.tokens(frags.filter("seq_id < 2"), (8,))
    got = features.saliency(toks, found).collect()
    assert len(got) == 2 * 21 and all(r.weight >= 0 for r in got) and any(r.weight > 0 for r in got)


def test_folds_are_calibrated_by_the_others(spark):
    r = random.Random(1)
    rows = [(i % 3, i, y := i // 3 % 3, *(0.6 if c == y else 0.2 for c in range(3))) for i in range(90)]
    oof = spark.createDataFrame(rows, "fold int, seq_id long, label int, p0 double, p1 double, p2 double")
    got = classify.calibrated_folds(oof, 3).collect()
    assert len(got) == 90 and all((r.p0, r.p1, r.p2)[r.label] > 0.99 for r in got)


def test_window_sweep_reports_each_size_with_windows(spark):
    got = classify.window_sweep(labelled(spark, 18), (300, 600), per_class=6, n_folds=2, ks=(4,), terms=64).collect()
    assert sorted((x.window, x.n_windows) for x in got) == [(300, 36), (600, 18)]
    assert all(x.macro_auroc > 0.9 and x.recall_0 > 0.5 and x.lo <= x.auroc_natural <= x.hi for x in got)


def test_risk_along_a_record(spark):
    df = labelled(spark, 12)
    model = classify.fit_logistic(classify.training_fragments(df), 64, 10)
    got = classify.risk_track(df.select("seq_id", "seq"), model).filter("seq_id = 1").orderBy("x").collect()
    assert [x.x for x in got] == [250, 300, 350] and all(0 <= x.risk <= 100 for x in got)


def test_platt_follows_the_raw_score(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = spark.createDataFrame([(x / 20, float(x > 10 or x % 5 == 0)) for x in range(20)], "raw double, y double")
    out = anomaly.platt(df).transform(df.withColumn("_f", array_to_vector(F.array("raw")))).select("raw", vector_to_array("_p")[1].alias("p")).orderBy("raw").collect()
    assert all(a.p < b.p for a, b in zip(out, out[1:], strict=False)) and 0 < out[0].p < 0.5 < out[-1].p < 1


def test_labelled_files_and_sinks(spark, tmp_path):
    (tmp_path / "n.fa").write_text(">a one\nATGC\n>b\nAT\n>c\nATGCAT\n")
    (tmp_path / "v.fa").write_text(">d\nGGGG\n>e\nCCCC\n")
    n, v = str(tmp_path / "n.fa"), str(tmp_path / "v.fa")
    got = fasta.read_labelled(spark, {n: 0, v: 1}, most={v: 1}).collect()
    assert sorted((r.seq_id, r.label) for r in got) == [("a", 0), ("c", 0), ("d", 1)]
    assert fasta.read_tests(spark, {n: 0, v: 1}).count() == 4
    with pytest.raises(FileNotFoundError):
        fasta.read_tests(spark, {n: 0, str(tmp_path / "none.fa"): 1})
    both = fasta.tagged({"LEFT": fasta.read_fasta(spark, n), "RIGHT": fasta.read_fasta(spark, v)}).collect()
    assert {r.seq_id: r.description for r in both}["a"] == "a one SRC=LEFT" and len(both) == 5
    table = spark.createDataFrame([("x", 0.123456, 2)], "name string, v double, n int")
    fasta.write_csv(table, f"{tmp_path}/out.csv")
    found = fasta.read_results(spark, {"cv": f"{tmp_path}/out.csv", "none": f"{tmp_path}/none.csv"})
    assert list(found) == ["cv"] and tuple(found["cv"].first()) == ("x", 0.1235, 2)
    fasta.write_evidence(spark.createDataFrame([("line one\nline two",)], "evidence string"), f"{tmp_path}/ev")
    assert spark.read.text(f"{tmp_path}/ev").count() == 2


def test_bounded_engine(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(120):
        v = np.zeros(256, np.float32)
        at = rng.choice(20, 8) + (100 if i % 3 == 2 else 0)
        v[at] = 1 / 8
        rows.append((i, 0, v.tolist()))
        if i < 100:
            labels.append((i, i % 3))
    vectors = spark.createDataFrame(rows, "seq_id long, idx int, v array<float>")
    known = spark.createDataFrame(labels, "seq_id long, label int")
    got = {r.seq_id: r.p for r in anomaly.bounded_engine(vectors, known, trees=30, calibrated_on=20).collect()}
    assert len(got) == 120 and all(0 <= p <= 1 for p in got.values())
    assert min(p for i, p in got.items() if i % 3 == 2) > max(p for i, p in got.items() if i % 3 == 0)
    assert anomaly.bounded_engine(vectors, known.filter("label = 0"), trees=3).count() == 0
