import math

import pytest
from pyspark.sql import functions as F

from strandsieve.functions import text as T
from strandsieve.operators import codon, motif, seq


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")


def test_fragments_keep_or_drop_the_tail(spark):
    df = seqs(spark, "A" * 1003, "C" * 1010, "G" * 500, "T" * 7, "", "AC", None)
    got = {}
    for r in seq.fragments(df).orderBy("seq_id", "idx").collect():
        got.setdefault(r.seq_id, []).append((r.start, len(r.frag)))
    assert got == {0: [(0, 500), (500, 500)], 1: [(0, 500), (500, 500), (1000, 10)], 2: [(0, 500)], 3: [(0, 7)]}
    dropped = seq.whole_fragments(df).groupBy("seq_id").agg(F.sum(F.length("frag")).alias("n")).collect()
    assert {r.seq_id: r.n for r in dropped} == {0: 1000, 1: 1000, 2: 500, 3: 7}


def test_token_numbers(spark):
    df = seqs(spark, "ATGC" * 5 + "ATG", "A" * 500, "ATG")
    n = seq.tokens(seq.fragments(df, least=1)).groupBy("seq_id").count().collect()
    assert {r.seq_id: r["count"] for r in n} == {0: 54, 1: 1485}


def test_windows_of_long_sequences(spark):
    text = "".join("ATGC"[(i * i + i // 3) % 4] for i in range(5000))
    got = seq.kmers(seqs(spark, text), 7).orderBy("pos").collect()
    assert [(r.pos, r.kmer) for r in got] == [(i, text[i : i + 7]) for i in range(len(text) - 6)]
    slid = seq.sliding(seqs(spark, text), 300, 7).orderBy("start").collect()
    assert [(r.start, r.win) for r in slid] == [(i, text[i : i + 300]) for i in range(0, len(text) - 299, 7)]


def test_frequencies_sum_to_one(spark):
    v = seq.kmer_vectors(seq.fragments(seqs(spark, "ATGCNATGGGCC" * 50, "NNNNNN")), ("seq_id", "idx"))
    sums = v.groupBy("seq_id", "idx").agg(F.sum("freq").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums) and {r.seq_id for r in sums} == {0}


def test_composition_of_a_fragment(spark):
    r = seq.composition(seqs(spark, "ATGCGC", "NN").withColumnRenamed("seq", "frag")).orderBy("seq_id").collect()
    assert (round(r[0].gc, 6), r[0].cpg, r[0].gc3) == (0.666667, 0.2, 1.0) and (r[1].gc, r[1].cpg, r[1].gc3) == (0.0, 0.0, 0.0)
    e = seqs(spark, "ATGC", "AAAA", "").select(T.entropy("seq").alias("e")).collect()
    assert [x.e for x in e] == [2.0, 0.0, 0.0]


def test_codon_goldens(spark):
    df = seqs(spark, "ATGATGTTTTTC", "", "TAATAG", "ATGNNN")
    r = {(x.seq_id, x.codon): x.rscu for x in codon.rscu(codon.codon_counts(df)).collect()}
    assert r == {(0, "ATG"): 1.0, (0, "TTT"): 1.0, (0, "TTC"): 1.0, (3, "ATG"): 1.0}
    s = {x.seq_id: x for x in codon.codon_summary(df).collect()}
    assert s[0].cai == round((16.5 / 22) ** 0.25, 4) == 0.9306 and s[0].bias == 0 and s[0].n_codons == 4 and s[0].top_codon == "TTT"
    assert (s[1].n_codons, s[1].cai, s[1].top_codon) == (0, 0.0, "N/A") and s[2].n_codons == 0
    table = codon.codon_rows()
    assert len(table) == 61 and sum(w == 1.0 for *_, w in table) >= 20 and dict((c, a) for _, c, a, *_ in table)["TGG"] == "W"


def test_motifs(spark):
    df = seqs(spark, "TTGTAAAACGACGGCCAGTAA", "ANANAN", "")
    assert [(r.seq_id, r.name) for r in motif.motif_scan(df, motif.LAB_MOTIFS).collect()] == [(0, "pUC19/M13 forward primer site")]
    got = motif.motif_positions(df, {"x": "ANAN", "y": "GT"}).collect()
    assert sorted((r.seq_id, r.name, r.start, r.end) for r in got) == [(0, "y", 3, 4), (0, "y", 18, 19), (1, "x", 1, 4), (1, "x", 3, 6)]


def test_enrichment(spark):
    df = seqs(spark, "ATGCAT" * 10, "ATGCAT", "CCCCCCCC")
    got = motif.enriched_kmers(df, 6, 1, background=df.filter("seq_id = 0")).orderBy("seq_id").collect()
    assert got[2].kmer == "CCCCCC" and math.isclose(got[2].fold, 1.0 / (1 / (55 + 4096)))


@pytest.mark.parametrize(("p", "label"), [([0.2, 0.2, 0.6], 2), ([0.4, 0.4, 0.2], 0)])
def test_argmax_and_risk(spark, p, label):
    r = spark.range(1).select(T.argmax(F.array(*map(F.lit, p))).alias("a"), T.risk(F.array(*map(F.lit, p)), F.lit(100)).alias("r"), T.risk(F.array(*map(F.lit, p)), F.lit(100), classes=2).alias("two")).first()
    assert r.a == label and math.isclose(r.r, (p[1] + p[2]) * 100) and math.isclose(r.two, p[1] * 100)


def test_headers_and_ids(spark):
    df = spark.createDataFrame([("a_b_vector_hard", "x"), ("q", "q SRC=LABEL_NATURAL vector"), ("q", "natural easy"), ("q", "none"), ("", "")], "id string, h string")
    known = ("NATURAL", "VECTOR", "SYNTHETIC")
    got = df.select(T.header_label(F.col("h"), F.col("id"), known).alias("l"), T.header_level(F.col("h"), F.col("id")).alias("d"), T.safe_id("id").alias("s")).collect()
    assert [(r.l, r.d) for r in got] == [("VECTOR", "HARD"), ("NATURAL", "UNKNOWN"), ("NATURAL", "EASY"), ("UNKNOWN", "UNKNOWN"), ("UNKNOWN", "UNKNOWN")] and got[4].s == "sequence"
    e = spark.createDataFrame([(0.0,), (1.5e-7,)], "e double").select(T.format_evalue(F.col("e")).alias("t")).collect()
    assert [r.t for r in e] == ["0", "1.50e-07"]


def test_sampled_fragments_dont_depend_on_partitions(spark):
    df = seqs(spark, *("ATGC" * (6 + i) for i in range(30)))
    a = sorted(map(tuple, seq.sampled_fragments(df, 50).collect()))
    b = sorted(map(tuple, seq.sampled_fragments(df.repartition(7), 50).collect()))
    assert a == b and len(a) == 50 and all(20 <= len(f) <= 150 for *_, f in a)


def test_enrichment_feature(spark):
    df = seqs(spark, "ATGCAT" * 10, "AT", "CCCCCCCC")
    enriched = motif.enriched_kmers(df, 6, 3, background=df.filter("seq_id = 0"))
    got = {r.seq_id: r.max_fold for r in motif.enrichment_feature(enriched, df).collect()}
    assert got[1] == 0.0 and math.isclose(got[2], 1.0 / (1 / (55 + 4096)))


def test_kmers_are_not_shuffled(spark):
    plan = seq.kmer_counts(seqs(spark, "ATGCAT" * 10), 6)._jdf.queryExecution().executedPlan().toString()
    assert "kmer" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_stricter_and_binary_labels(spark):
    df = spark.createDataFrame([("rec_vector", "SRC=LABEL_NATURAL", None), ("rec_vector", "x", None), ("r", "natural text", None), ("r", "", "SYNTHETIC")], "id string, h string, g string")
    known = ("NATURAL", "VECTOR", "SYNTHETIC")
    got = df.select(T.tagged_label(F.col("h"), F.col("id"), F.col("g"), known).alias("t"), T.binary_label(F.col("h")).alias("y")).collect()
    assert [tuple(r) for r in got] == [("NATURAL", 0), ("VECTOR", None), (None, 0), ("SYNTHETIC", None)]
