"""Terms and 4-mers counted as numbers, against plain counts; rows with other letters, repeated keys, and plans without a row for each place."""

import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandsieve.operators import anomaly, classify, features, seq, terms
from strandsieve.plans import catalog

KS = (4, 6, 8)


def plain(frag, ks=KS):
    tokens = [f"k{k}_{frag[i : i + k]}" for k in ks for i in range(len(frag) - k + 1)]
    return Counter([*tokens, *map(" ".join, pairwise(tokens))])


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    odd = ["", "ATG", "ATGC", "ATGCA", "ATGCATG", "ATGCATGC", "ATGéCATGCA", "XXXXATGCATGCX", "NNNNNNNN"]
    return [(i % 37, i // 37, x) for i, x in enumerate(odd + ["".join(r.choices("ACGTN", k=r.randint(0, 500))) for _ in range(80)])] + [(3, 0, "ATGCATGC"), (3, 0, None)]


@pytest.fixture(scope="module")
def frags(spark, texts):
    return spark.createDataFrame(texts, "seq_id long, idx long, frag string").repartition(5)


def by_key(texts):
    out = {}
    for a, b, x in texts:
        out.setdefault((a, b), Counter()).update(plain(x or ""))
    return out


def test_terms_equal_plain_counts(frags, texts):
    got = {}
    for r in features.term_counts(frags, ("seq_id", "idx")).collect():
        got.setdefault((r.seq_id, r.idx), Counter())[r.token] += r.tf
    assert got == {k: v for k, v in by_key(texts).items() if v}


@pytest.mark.parametrize("most", [1, 1 << 21])
def test_statistics_equal_plain_counts(frags, texts, most):
    df, n = Counter(), Counter()
    for v in by_key(texts).values():
        df.update(v.keys())
        n.update(v)
    got = features.term_statistics(frags, ("seq_id", "idx"), most=most).collect()
    assert {r.token: (r.df, r.n) for r in got} == {x: (df[x], n[x]) for x in df} and len(got) == len(df)


def test_weights_equal_the_joined_ones(frags):
    by = ("seq_id", "idx")
    counts, n = features.term_counts(frags, by), frags.count()
    vocab = features.vocabulary(counts, 2, 3000)
    want = {(r.seq_id, r.idx, r.token): r.weight for r in features.tfidf(counts, vocab, n, by).collect()}
    own = features.most_frequent(features.term_statistics(frags, by, least=2), 2, 3000)
    assert own.collect() == vocab.collect()
    got = {(r.seq_id, r.idx, r.token): r.weight for r in features.weights(frags, by, own, n).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - w) < 1e-12 for k, w in want.items())
    rounded = features.tfidf(counts, vocab, n, by).withColumn("weight", F.round("weight", 9))
    best = {(r.seq_id, r.idx, r["rank"], r.token) for r in features.top_tokens(rounded, by).collect()}
    assert {(r.seq_id, r.idx, r["rank"], r.token) for r in features.weights(frags, by, own, n, top=5, digits=9).collect()} == best


def test_numbers_are_names(spark):
    known = terms.Terms(KS)
    names = sorted(plain("ATGCNNATGCATTTACG"))
    ids = np.array([known.number(x) for x in names])
    assert (ids >= 0).all() and len(set(ids)) == len(names) and known.names(ids).to_pylist() == names
    assert [known.number(x) for x in ("k4_ATGX", "k4_ATG", "k5_ATGCA", "k4_ATGC k4_AAAA", "k8_ATGCATGC k4_ATGC")] == [-1] * 5


def test_vectors_equal_plain_frequencies(frags, texts):
    joined = {}
    for a, b, x in texts:
        joined.setdefault((a, b), []).append((x or "").replace("N", ""))
    for r in anomaly.vector_table(frags).collect():
        kmers = [x[i : i + 4] for x in joined.pop((r.seq_id, r.idx)) for i in range(len(x) - 3)]
        want = np.array([kmers.count(k) / max(1, len(kmers)) for k in anomaly.ALPHABET4], np.float32)
        assert np.array_equal(np.array(r.v, np.float32), want)
    assert not joined


def test_no_row_is_made_for_each_place(frags):
    made = [features.term_counts(frags, ("seq_id", "idx")), features.term_statistics(frags), anomaly.vector_table(frags)]
    assert not any("Generate explode" in x._jdf.queryExecution().executedPlan().toString() for x in made)


def test_k_mers_of_records_equal_plain_counts(spark):
    r = random.Random(8)
    rows = [(i % 11, "".join(r.choices("ATGCN" if i % 7 else "ATGCNX", k=r.randint(0, 90)))) for i in range(40)] + [(None, "ATGCATGCA"), (50, None), (51, "ATG")]
    want = {}
    for i, x in rows:
        for a in range(len(x or "") - 5):
            n, first = want.get((i, x[a : a + 6]), (0, a))
            want[i, x[a : a + 6]] = n + 1, min(first, a)
    got = seq.kmer_counts(spark.createDataFrame(rows, "seq_id long, seq string").repartition(4), 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {(r.seq_id, r.kmer): (r.cnt, r.first_pos) for r in got.collect()} == want and "Window" not in plan and "explode" not in plan
    totals = Counter()
    for (i, _), (n, _) in want.items():
        totals[i] += n
    assert all(r.total == totals[r.seq_id] and abs(r.freq - r.cnt / r.total) < 1e-15 for r in got.collect())


def test_scales_are_fitted_before_terms_are_counted(spark):
    names = [type(x).__name__ for x in classify.stages(16)]
    assert names.index("StandardScaler") < names.index("SublinearTfidf")


def test_importances_are_sent_to_the_tokens(spark):
    toks = spark.createDataFrame([(1, 0, "k8_A"), (1, 1, "k8_C")], "seq_id long, pos long, token string")
    got = features.saliency(toks, spark.createDataFrame([("k8_A", -0.5)], "token string, weight double"))
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.token, r.weight) for r in got.collect()} == {("k8_A", 0.5), ("k8_C", 0.0)}


def test_fragments_to_weigh_are_cut_once(spark, sf_dir):
    plan = catalog.QUERIES["top_tokens"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan


def test_largest_hold_the_first(spark):
    rng = np.random.default_rng(3)
    own = np.repeat(np.arange(6), [1, 4, 5, 30, 200, 3])
    w = np.where(own == 3, 0.5, np.round(rng.random(len(own)), 1))
    keep = features.largest(own, w, 5)
    for g in range(6):
        mine = w[own == g]
        assert sorted(mine[keep[own == g]])[::-1][:5] == sorted(mine)[::-1][:5] and keep[own == g].sum() >= min(5, len(mine))
    assert not len(features.largest(own[:0], w[:0], 5))


def test_weights_are_rounded_where_they_are_made(spark, sf_dir):
    got = catalog.QUERIES["tfidf_weights"](spark, sf_dir)
    assert "round(" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("abs(weight * 1e6 - round(weight * 1e6)) > 1e-6 or weight <= 0").isEmpty() and not got.isEmpty()
