import math
import random

import numpy as np
from pyspark.sql import functions as F

from strandsieve.operators import evidence, folds, homology, metrics, ranges, stats


def scores(spark, pos, neg):
    return spark.createDataFrame([("k", 1, x) for x in pos] + [("k", 0, x) for x in neg], "key string, y int, x double")


def test_auroc_golden_and_symmetry(spark):
    df = scores(spark, [0.9, 0.8], [0.8, 0.1])
    assert metrics.auroc(df, ("key",)).first().auroc == 0.875
    r = random.Random(1)
    df = scores(spark, [r.randint(0, 9) / 10 for _ in range(40)], [r.randint(0, 7) / 10 for _ in range(60)])
    a, b = (metrics.auroc(d, ("key",)).first().auroc for d in (df, df.withColumn("x", -F.col("x"))))
    assert math.isclose(a, 1 - b)
    d = metrics.delong(df, ("key",)).first()
    assert math.isclose(d.auroc, a) and d.lo < a < d.hi


def test_delong_against_placements(spark):
    r = random.Random(2)
    pos, neg = [r.randint(0, 9) / 10 for _ in range(15)], [r.randint(0, 7) / 10 for _ in range(20)]
    win = lambda p, n: (p > n) + (p == n) / 2
    v = [sum(win(p, n) for n in neg) / len(neg) for p in pos]
    u = [sum(win(p, n) for p in pos) / len(pos) for n in neg]
    var = lambda z: sum((x - sum(z) / len(z)) ** 2 for x in z) / (len(z) - 1)
    got = metrics.delong(scores(spark, pos, neg), ("key",)).first()
    assert math.isclose(got.variance, var(v) / len(v) + var(u) / len(u), rel_tol=1e-9)
    assert metrics.delong(scores(spark, [0.5], [0.1]), ("key",)).first().variance == 0


def test_one_kind_only(spark):
    assert metrics.auroc(scores(spark, [0.1], []), ("key",)).first().auroc is None
    assert metrics.average_precision(scores(spark, [], [0.1]), ("key",)).first().ap is None
    assert metrics.auroc(scores(spark, [], []), ("key",)).count() == 0


def test_midranks(spark):
    got = metrics.midranks(scores(spark, [1.0, 2.0, 2.0], [3.0]), ("key",)).collect()
    assert sorted((r.x, r.midrank) for r in got) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0)]


def test_mcnemar_and_wilson(spark):
    df = spark.createDataFrame([(1, 1, 0)] * 30 + [(1, 0, 1)] * 10 + [(1, 1, 1)] * 5, "y int, own int, tool int")
    got = stats.mcnemar_suite(df, ["tool"], "own").first()
    assert (got.n10, got.n01, got.n11, got.chi2) == (30, 10, 5, 9.025)
    assert stats.mcnemar_p(30, 10) == (9.025, round(math.erfc(math.sqrt(9.025 / 2)), 4)) and stats.mcnemar_p(0, 0) == (0.0, 1.0) and stats.mcnemar_p(8, 2)[1] == round(56 / 1024, 4)
    w = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert [round(x, 4) for x in w[0].w] == [0.4902, 0.9433, 0.7167] and list(w[1].w) == [0.0, 0.0, 0.0]


def test_coverage_of_overlapping_hits(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 5, 20), (1, 31, 40), (1, 6, 7)], "query_id long, q_start long, q_end long")
    lengths = spark.createDataFrame([(1, 100), (2, 50), (3, 0)], "seq_id long, len int")
    assert {r.seq_id: r.coverage for r in homology.coverage(hits, lengths).collect()} == {1: 30.0, 2: 0.0, 3: 0.0}


def test_homology_finds_both_strands(spark):
    r = random.Random(4)
    ref = "".join(r.choice("ATGC") for _ in range(200))
    flip = ref[::-1].translate(str.maketrans("ATGC", "TACG"))
    noise = "".join(r.choice("ATGC") for _ in range(80))
    q = spark.createDataFrame([(1, noise + ref[20:120]), (2, flip[50:150] + noise), (3, noise), (4, "")], "seq_id long, seq string")
    got = {h.query_id: h for h in homology.homology_hits(q, spark.createDataFrame([(9, ref)], "ref_id long, seq string")).collect()}
    assert set(got) == {1, 2}
    assert (got[1].q_start, got[1].q_end, got[1].s_start, got[1].s_end, got[1].percent_identity) == (81, 180, 21, 120, 100.0)
    assert (got[2].q_start, got[2].q_end, got[2].s_start, got[2].s_end) == (1, 100, 150, 51)


def test_homology_keeps_frequent_seeds(spark):
    r = random.Random(5)
    ref = "".join(r.choice("ATGC") for _ in range(60))
    q = spark.createDataFrame([(1, "ATTA" + ref), (2, "G" * 30)], "seq_id long, seq string")
    refs = spark.createDataFrame([(i, ref) for i in range(1100)] + [(5000, "G" * 1050)], "ref_id long, seq string")
    got = homology.homology_hits(q, refs).collect()
    assert sorted(h.subject_id for h in got if h.query_id == 1) == list(range(1100))
    assert {(h.q_start, h.q_end, h.s_start, h.s_end) for h in got if h.query_id == 1} == {(5, 64, 1, 60)}
    # diagonals of at least one seed; the shortest ones are below the significance limit
    assert {h.s_start - h.q_start for h in got if h.query_id == 2} >= set(range(1021)) and len({(h.q_start, h.q_end, h.s_start) for h in got}) == len([h for h in got if h.query_id == 2]) + 1


def test_groups_stay_in_one_fold(spark):
    df = spark.createDataFrame([(g, g % 3) for g in range(90) for _ in range(g % 5 + 1)], "g long, label int")
    got = folds.group_folds(df, "g", "label")
    assert got.count() == 90 and folds.leaks(got, "g").count() == 0
    by = got.groupBy("label", "fold").count().collect()
    assert {r["count"] for r in by} == {6}


def test_bootstrap_interval_holds_the_estimate(spark):
    r = random.Random(6)
    df = scores(spark, [r.gauss(1, 1) for _ in range(60)], [r.gauss(0, 1) for _ in range(90)]).withColumn("x", F.round("x", 2))
    ap = metrics.average_precision(df, ("key",)).first().ap
    b = stats.bootstrap_ap(df, 200).first()
    assert b.n == 200 and b.ap_lo < ap < b.ap_hi


def test_verdict_cascade(spark):
    rows = [(1, 0, 0.0, 500), (0, 1, 0.0, 500), (0, 0, 90.0, 10), (0, 0, 60.0, 500), (0, 0, 35.0, 500), (0, 0, 34.9, 500), (0, 0, 90.0, 0)]
    df = spark.createDataFrame(rows, "h int, m int, r double, n int")
    got = [x.v for x in df.select(evidence.verdict(*(F.col(c) for c in "hmrn")).alias("v")).collect()]
    assert got == ["CONFIRMED LAB-ENGINEERED"] * 2 + ["BORDERLINE / REVIEW", "SUSPECTED ENGINEERED", "BORDERLINE / REVIEW", "LIKELY NATURAL", "SUSPECTED ENGINEERED"]
    dual = df.select(evidence.verdict(*(F.col(c) for c in "hmrn"), ood=F.lit(1.0)).alias("v")).collect()
    assert dual[3].v == dual[4].v == "LIKELY NATURAL"


def test_weights(spark, tmp_path):
    path = f"{tmp_path}/w"
    evidence.save_weights(spark, {"kmer": 2.0, "ood": 1.0, "blast": 0.5, "motif": 0.5, "codon": 0.0}, path)
    w = evidence.load_weights(spark, path)
    assert w["kmer"] == 0.5 and abs(sum(w.values()) - 1) < 1e-12


def test_running_sums_over_many_ranges(spark):
    r = random.Random(8)
    rows = [(k, float(x), r.randint(0, 5)) for k in "ab" for x in r.sample(range(5000), 700)]
    got = ranges.running_sums(spark.createDataFrame(rows, "key string, x double, n long"), ("key",), "x", ("n",)).collect()
    want = {(k, x): sum(m for j, y, m in rows if j == k and y < x) for k, x, _ in rows}
    assert {(g.key, g.x): g.below_n for g in got} == want and {g.all_n for g in got if g.key == "a"} == {sum(m for k, _, m in rows if k == "a")}
    ranked = ranges.hash_rank(spark.range(3000).withColumn("g", F.col("id") % 2), ("g",), "id").collect()
    for g in (0, 1):
        order = sorted((x for x in range(3000) if x % 2 == g), key=lambda x: ((x * 2654435761 + 42) % 1_000_003, x))
        assert [x.id for x in sorted((x for x in ranked if x.g == g), key=lambda x: x._rank)] == order


def test_poisson_draws():
    n = stats.draws(np.arange(200), np.ones(200, np.int64), 100)
    share = {k: float((n == k).mean()) for k in range(8)}
    assert abs(sum(n * p for n, p in share.items()) - 1) < 0.05 and abs(share[0] - math.exp(-1)) < 0.02 and abs(share[2] - math.exp(-1) / 2) < 0.02


def test_bootstrap_is_that_of_plain_draws(spark):
    """Ties, a score of many rows, and several ranges against one sum over all rows."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random(700), 2)
    x[:300] = 0.5
    y = (rng.random(700) < 0.3 + 0.4 * x).astype(int)
    want = []
    draws = np.zeros((700, 60))
    for k in (0, 1):
        at = np.flatnonzero(y == k)[np.argsort(x[y == k], kind="stable")]
        draws[at] = stats.draws(np.arange(len(at)), np.full(len(at), k), 60)
    for b in range(60):
        tp = fp = area = 0.0
        for v in sorted(set(x), reverse=True):
            p, n = draws[(x == v) & (y == 1), b].sum(), draws[(x == v) & (y == 0), b].sum()
            tp, fp = tp + p, fp + n
            area += p * tp / (tp + fp) if tp + fp else 0.0
        want.append(area / tp)
    got = stats.bootstrap_ap(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x, strict=True)], "y int, x double"), 60).first()
    assert got.n == 60 and abs(got.ap_lo - np.percentile(want, 2.5)) < 1e-9 and abs(got.ap_hi - np.percentile(want, 97.5)) < 1e-9
    assert tuple(stats.bootstrap_ap(spark.createDataFrame([], "y int, x double"), 5).first()) == (None, None, 0)


def test_erfc(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erfc(r.x)) < 2e-7 for r in got)


def test_recalls_tools_and_summary(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 2, 1)], "fold int, y int, p int")
    got = {r["class"]: (r.folds, r.recall) for r in metrics.mean_recalls(df, "fold", [0, 1, 2, 3]).collect()}
    assert got == {0: (2, 0.75), 1: (1, 1.0), 2: (1, 0.0), 3: (0, None)}
    s = scores(spark, [0.9, 0.6], [0.4, 0.1]).withColumnRenamed("key", "tool")
    t = {r.tool: (r.auroc, r.auprc, r.f1) for r in metrics.tool_comparison(s, ["k", "none"]).collect()}
    assert t == {"k": (1.0, 1.0, 1.0), "none": (None, None, None)}
    e = metrics.evaluation_summary(s, [0.2, 0.5, 0.7], ("tool",)).first()
    assert (e.auroc, e.ap, e.base, e.threshold, e.precision, e.recall, e.f1) == (1.0, 1.0, 0.5, 0.5, 1.0, 1.0, 1.0)


def test_second_source_only_where_the_first_is_short(spark):
    a = spark.createDataFrame([(1, 0), (1, 1), (2, 2)], "id long, o int")
    b = spark.createDataFrame([(2, 0), (3, 1), (4, 2)], "id long, o int")
    take = lambda few, n: [r.id for r in folds.first_with_second(a, b, "id", ["o"], n, few).collect()]
    assert take(2, 10) == [1, 2] and take(3, 10) == [1, 2, 3, 4] and take(3, 3) == [1, 2, 3]


def test_best_weights_are_never_below_equal_ones(spark):
    r = random.Random(2)
    rows = [(y := i % 2, y * 0.6 + r.random(), r.random(), y * 0.2 + r.random()) for i in range(80)]
    grid = evidence.fusion_grid(spark.createDataFrame(rows, "y int, a double, b double, c double"), ["a", "b", "c"], 3)
    best = evidence.best_weights(grid, ["a", "b", "c"]).first()
    assert grid.count() == 10 and best.auroc >= best.equal_auroc


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 1001), (3, 800)) for v in (np.round(rng.normal(size=n), 2) if k < 3 else np.r_[np.zeros(500), rng.random(300)])]
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: r.q for r in ranges.quantiles(spark.createDataFrame([*rows, (2, None), (4, None)], "k int, x double"), ("k",), "x", shares).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for j, v in rows if j == k], shares), rtol=0, atol=1e-12)
    every = ranges.quantiles(spark.createDataFrame(rows, "k int, x double"), (), "x", [0.5]).first().q
    assert abs(every[0] - np.median([v for _, v in rows])) < 1e-12
