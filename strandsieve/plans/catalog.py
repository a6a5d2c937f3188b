"""Registered queries of the screening and evaluation operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anomaly, classify, codon, evidence, features, folds, gapped, homology, metrics, motif, screening, seq, stats, training as nested
from ..operators.staging import shared_path, staged
from ..sources import models
from .inputs import finished, labels, references, scored, sequences, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 6):
    """Register a function under its name, with its SQL; without digits its doubles are rounded already."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: finished(f(spark, sf_dir), digits)
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


SEQS = "seqs AS (SELECT doc_id AS seq_id, source, lang, upper(regexp_replace(coalesce(text, ''), '[^ATGCNatgcn]', '', 'g')) AS seq FROM documents)"
REFS = "refs AS (SELECT item_id AS ref_id, upper(regexp_replace(coalesce(text, ''), '[^ATGCNatgcn]', '', 'g')) AS seq FROM benchmark)"
LABELS = "lab AS (SELECT doc_id AS seq_id, CASE WHEN quality = 0 THEN 1 WHEN toxic = 1 THEN 2 ELSE 0 END AS label FROM labels)"
FRAGS = "frags AS (SELECT seq_id, i AS idx, i * 500 AS start, substr(seq, i * 500 + 1, 500) AS frag FROM (SELECT seq_id, seq, unnest(range(0, (length(seq) + 499) // 500)) AS i FROM seqs) WHERE length(substr(seq, i * 500 + 1, 500)) >= 4)"


def n_of(letters: str, col: str = "seq") -> str:
    return f"(length({col}) - length(translate({col}, '{letters}', '')))"


SCORED = f"scored AS (SELECT seq_id, label, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y, round(coalesce({n_of('GC')} / nullif(length(seq), 0), 0), 6) AS gc, round(coalesce({n_of('N')} / nullif(length(seq), 0), 0), 6) AS ns FROM seqs JOIN lab USING (seq_id))"
BASE = f"WITH {SEQS}, {LABELS}, {SCORED}"
BINARY = "pts AS (SELECT 'gc' AS score, y, gc AS x FROM scored UNION ALL SELECT 'ns', y, ns FROM scored)"
CUM = "cnt AS (SELECT score, x, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM pts GROUP BY ALL)"


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, y, x): both composition scores of the labelled records."""
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("score"), F.col(n).alias("x")) for n in ("gc", "ns")))).alias("s")
    return scored(spark, sf_dir).select("y", both).select("s.score", "y", "s.x")


# k-mers, fragments, composition


@query(f"""
WITH {SEQS},
km AS (SELECT seq_id, i - 1 AS pos, substr(seq, i, 6) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM seqs WHERE length(seq) >= 6)),
cnt AS (SELECT seq_id, kmer, count(*) AS cnt, min(pos) AS first_pos FROM km GROUP BY ALL),
tot AS (SELECT seq_id, count(*) AS total FROM km GROUP BY ALL),
bgs AS (SELECT seq_id, substr(seq, 1, 50000) AS seq FROM seqs WHERE length(seq) >= 4 ORDER BY seq_id LIMIT 20),
bk AS (SELECT substr(seq, i, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM bgs WHERE length(seq) >= 6)),
bg AS (SELECT kmer, count(*) AS bg FROM bk GROUP BY ALL), bt AS (SELECT count(*) AS bg_total FROM bk),
f AS (SELECT seq_id, kmer, cnt, first_pos, (cnt / total) / ((coalesce(bg, 0) + 1) / (bg_total + 4096)) AS fold FROM cnt JOIN tot USING (seq_id) LEFT JOIN bg USING (kmer) CROSS JOIN bt),
r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY fold DESC, first_pos) AS rank FROM f)
SELECT seq_id, rank, kmer, cnt, first_pos, round(fold, 6) AS fold FROM r WHERE rank <= 10
""")
def enriched_kmers(spark, sf_dir):
    return motif.enriched_kmers(sequences(spark, sf_dir))


@query(f"""
WITH {SEQS}
SELECT seq_id, length(seq) AS len, {n_of('GC')} AS n_gc, {n_of('N')} AS n_n, length(regexp_replace(seq, 'N', '', 'g')) AS len_strict,
 round(coalesce({n_of('GC')} / nullif({n_of('ATGC')}, 0) * 100, 0), 6) AS gc_percent,
 CASE WHEN length(seq) < 2000 THEN 'short' WHEN length(seq) < 10000 THEN 'medium' ELSE 'long' END AS length_bucket,
 left(regexp_replace(source || '|' || seq_id, '[^A-Za-z0-9_.-]', '_', 'g'), 64) AS safe_id FROM seqs
""")
def clean_stats(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("seq_id", F.length("seq").alias("len"), T.letters("seq", "GC").alias("n_gc"), T.letters("seq", "N").alias("n_n"), F.length(T.clean("seq", "ATGC")).alias("len_strict"), T.gc_percent("seq").alias("gc_percent"), T.length_bucket(F.length("seq")).alias("length_bucket"), T.safe_id(F.concat("source", F.lit("|"), F.col("seq_id").cast("string"))).alias("safe_id"))


@query(f"""
WITH {SEQS}, g AS (SELECT seq_id, length(seq) AS len, coalesce({n_of('GC')} / nullif(length(seq), 0), 0) AS gc, coalesce({n_of('GC')} / nullif({n_of('ATGC')}, 0) * 100, 0) AS pc FROM seqs)
SELECT seq_id, len, CASE WHEN len < 50 THEN 'short' WHEN gc > 0.55 THEN 'plasmid_suspect' ELSE 'standard' END AS kind,
 CASE WHEN pc < 30 THEN 'low' WHEN pc > 65 THEN 'high' WHEN pc BETWEEN 40 AND 60 THEN 'typical' ELSE 'slightly outside' END AS gc_bucket FROM g
""")
def seq_type(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return s.select("seq_id", F.length("seq").alias("len"), T.sequence_type("seq").alias("kind"), T.gc_bucket(T.gc_percent("seq")).alias("gc_bucket"))


@query(f"WITH {SEQS} SELECT source, count(*) AS records, sum(length(seq))::BIGINT AS total_bp, min(length(seq)) AS min_bp, round(avg(length(seq)), 6) AS mean_bp, max(length(seq)) AS max_bp FROM seqs GROUP BY source")
def dataset_stats(spark, sf_dir):
    from ..sources.fasta import fasta_stats

    return fasta_stats(sequences(spark, sf_dir), "source")


@query(f"WITH {SEQS}, {FRAGS} SELECT * FROM frags")
def fragments(spark, sf_dir):
    return seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq"))


@query(f"""
WITH {SEQS}, n AS (SELECT seq_id, seq, CASE WHEN length(seq) >= 500 THEN (length(seq) - 500) // 500 + 1 ELSE 1 END AS n FROM seqs WHERE length(seq) >= 4)
SELECT seq_id, i AS idx, i * 500 AS start, substr(seq, i * 500 + 1, 500) AS frag FROM (SELECT seq_id, seq, unnest(range(0, n)) AS i FROM n)
""")
def fragments_drop_tail(spark, sf_dir):
    return seq.whole_fragments(sequences(spark, sf_dir).select("seq_id", "seq"))


@query(f"""
WITH {SEQS}, n AS (SELECT seq_id, seq, unnest(range(0, (length(seq) - 500) // 100 + 1)) AS i FROM seqs WHERE length(seq) >= 500)
SELECT seq_id, i * 100 + 250 AS centre, md5(substr(seq, i * 100 + 1, 500)) AS digest FROM n
""")
def sliding_windows(spark, sf_dir):
    s = seq.sliding(sequences(spark, sf_dir).select("seq_id", "seq"), 500, seq.default_step(500))
    return s.select("seq_id", (F.col("start") + 250).alias("centre"), F.md5(F.col("win").cast("binary")).alias("digest"))


@query(f"""
WITH {SEQS}, {FRAGS}, k AS (SELECT unnest([4, 6, 8]) AS k),
t AS (SELECT k, substr(frag, i, k) AS kmer FROM (SELECT frag, k, unnest(range(1, length(frag) - k + 2)) AS i FROM frags CROSS JOIN k WHERE length(frag) >= k))
SELECT 'k' || k || '_' || kmer AS token, count(*) AS n FROM t GROUP BY ALL
""")
def kmer_tokens(spark, sf_dir):
    return seq.tokens(seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {SEQS}, km AS (SELECT seq_id, i - 1 AS pos, substr(seq, i, 6) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM seqs WHERE length(seq) >= 6))
SELECT seq_id, kmer, count(*) AS cnt, min(pos) AS first_pos, round(count(*) / sum(count(*)) OVER (PARTITION BY seq_id), 6) AS freq FROM km GROUP BY seq_id, kmer
""")
def kmer_freq(spark, sf_dir):
    return seq.kmer_counts(sequences(spark, sf_dir).select("seq_id", "seq"), 6).drop("total")


@query(f"""
WITH {SEQS}, {FRAGS}, km AS (SELECT seq_id, idx, substr(frag, i, 4) AS kmer FROM (SELECT seq_id, idx, frag, unnest(range(1, length(frag) - 2)) AS i FROM frags)),
c AS (SELECT seq_id, idx, kmer, count(*) AS c FROM km WHERE kmer NOT LIKE '%N%' GROUP BY ALL)
SELECT seq_id, idx, kmer, round(c / sum(c) OVER (PARTITION BY seq_id, idx), 6) AS freq FROM c
""")
def kmer4_freq(spark, sf_dir):
    return seq.kmer_vectors(seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq")), ("seq_id", "idx"))


@query(f"""
WITH {SEQS}, {FRAGS}
SELECT seq_id, idx, round({n_of('GC', 'frag')} / length(frag), 6) AS gc, round((length(frag) - length(replace(frag, 'CG', ''))) / 2 / (length(frag) - 1), 6) AS cpg,
 round(len(list_filter(range(1, length(frag) // 3 + 1), lambda i: substr(frag, i * 3, 1) IN ('G', 'C'))) / (length(frag) // 3), 6) AS gc3 FROM frags
""")
def composition(spark, sf_dir):
    return seq.composition(seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq"))).select("seq_id", "idx", "gc", "cpg", "gc3")


@query(f"""
WITH {SEQS}, w AS (SELECT seq_id, seq, least(100, greatest(20, length(seq) // 20)) AS w FROM seqs WHERE length(seq) > 0),
s AS (SELECT *, greatest(1, w // 2) AS s FROM w), i AS (SELECT *, unnest(range(0, greatest(1, CASE WHEN length(seq) >= w THEN (length(seq) - w) // s + 1 ELSE 0 END))) * s AS a FROM s),
p AS (SELECT seq_id, a + w // 2 AS x, substr(seq, a + 1, w) AS p FROM i)
SELECT seq_id, x, round(coalesce({n_of('GC', 'p')} / nullif({n_of('ATGC', 'p')}, 0) * 100, 0), 6) AS gc FROM p
""")
def gc_track(spark, sf_dir):
    return seq.gc_track(sequences(spark, sf_dir).select("seq_id", "seq"))


@query(f"""
WITH {SEQS}, w AS (SELECT seq_id, seq, least(80, greatest(32, length(seq) // 15)) AS w FROM seqs WHERE length(seq) > 0),
s AS (SELECT *, greatest(10, w // 2) AS s FROM w), i AS (SELECT *, unnest(range(0, greatest(1, CASE WHEN length(seq) >= w THEN (length(seq) - w) // s + 1 ELSE 0 END))) * s AS a FROM s),
p AS (SELECT seq_id, a + w // 2 AS x, substr(seq, a + 1, w) AS p FROM i),
c AS (SELECT seq_id, x, length(p) AS n, unnest(['A', 'T', 'G', 'C', 'N']) AS l, p FROM p),
e AS (SELECT seq_id, x, (length(p) - length(replace(p, l, ''))) / n AS q FROM c)
SELECT seq_id, x, round(sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END), 6) AS entropy FROM e GROUP BY ALL
""")
def entropy_track(spark, sf_dir):
    return seq.entropy_track(sequences(spark, sf_dir).select("seq_id", "seq"))


# codons

CODONS = ", ".join(f"({o}, '{c}', '{a}', {h}, {s}, {w!r})" for o, c, a, h, s, w in codon.codon_rows())
CODON_SQL = f"codons(ord, codon, aa, host, synonyms, w) AS (VALUES {CODONS})"


def codon_sql(by: str, source: str) -> str:
    return f"""{CODON_SQL},
cut AS (SELECT {by}, substr(seq, i * 3 + 1, 3) AS codon FROM (SELECT {by}, seq, unnest(range(0, length(seq) // 3)) AS i FROM {source} WHERE length(seq) >= 3)),
counts AS (SELECT {by}, codon, aa, ord, synonyms, w, count(*) AS cnt FROM cut JOIN codons USING (codon) GROUP BY ALL),
aas AS (SELECT {by}, aa, sum(cnt) AS total FROM counts GROUP BY ALL),
rscu AS (SELECT aas.{by}, k.codon, aas.aa, k.ord, coalesce(c.cnt, 0)::BIGINT AS cnt, round(coalesce(c.cnt, 0) * k.synonyms / total, 4) AS rscu FROM aas JOIN codons k ON k.aa = aas.aa LEFT JOIN counts c ON c.{by} = aas.{by} AND c.codon = k.codon),
cai AS (SELECT {by}, sum(cnt)::BIGINT AS n_codons, round(exp(sum(cnt * ln(w::DOUBLE)) / sum(cnt)), 4) AS cai FROM counts GROUP BY ALL)"""


@query(f"WITH {SEQS}, {codon_sql('seq_id', 'seqs')} SELECT seq_id, codon, aa, ord::BIGINT AS ord, cnt, rscu FROM rscu")
def rscu(spark, sf_dir):
    return codon.rscu(codon.codon_counts(sequences(spark, sf_dir)))


@query(f"WITH {SEQS}, {codon_sql('seq_id', 'seqs')} SELECT * FROM cai")
def cai(spark, sf_dir):
    return codon.cai(codon.codon_counts(sequences(spark, sf_dir)))


def summary_sql(by: str, source: str, base: str) -> str:
    return f"""{base}, {codon_sql(by, source)},
used AS (SELECT {by}, round(avg(abs(rscu - 1)), 4) AS bias FROM rscu GROUP BY ALL),
hi AS (SELECT {by}, codon, rscu, row_number() OVER (PARTITION BY {by} ORDER BY rscu DESC, ord) AS n FROM rscu WHERE rscu > 0),
lo AS (SELECT {by}, codon, rscu, row_number() OVER (PARTITION BY {by} ORDER BY rscu, ord) AS n FROM rscu WHERE rscu > 0),
o AS (SELECT s.{by}, coalesce(n_codons, 0) AS n_codons, coalesce(cai, 0) AS cai, coalesce(bias, 0) AS bias, coalesce(hi.codon, 'N/A') AS top_codon, coalesce(hi.rscu, 0) AS top_rscu, coalesce(lo.codon, 'N/A') AS bottom_codon, coalesce(lo.rscu, 0) AS bottom_rscu
 FROM (SELECT DISTINCT {by} FROM {source}) s LEFT JOIN cai USING ({by}) LEFT JOIN used USING ({by}) LEFT JOIN hi ON hi.{by} = s.{by} AND hi.n = 1 LEFT JOIN lo ON lo.{by} = s.{by} AND lo.n = 1)
SELECT *, cai > 0.65 OR bias > 0.45 AS flag, CASE WHEN cai > 0.75 AND bias > 0.5 THEN 'strong' WHEN cai > 0.65 OR bias > 0.45 THEN 'moderate' ELSE 'none' END AS level FROM o"""


@query(summary_sql("seq_id", "seqs", f"WITH {SEQS}"))
def codon_summary(spark, sf_dir):
    return codon.codon_summary(sequences(spark, sf_dir))


@query(summary_sql("label", "labelled", f"WITH {SEQS}, {LABELS}, labelled AS (SELECT label::BIGINT AS label, seq FROM seqs JOIN lab USING (seq_id))"))
def codon_usage_by_label(spark, sf_dir):
    both = sequences(spark, sf_dir).join(labels(spark, sf_dir), "seq_id")
    return codon.codon_summary(both, ("label",))


# motifs and homology

#: Short patterns that occur in the driver's texts, beside the laboratory motifs.
MOTIFS = {**motif.LAB_MOTIFS, "short a": "TANANTAN", "short b": "TTNTTANT", "short c": "ANTANANT"}
MOTIF_SQL = "motifs(name, pattern) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in MOTIFS.items()) + ")"


@query(f"WITH {SEQS}, {MOTIF_SQL} SELECT seq_id, name FROM seqs JOIN motifs ON contains(seq, pattern)")
def motif_scan(spark, sf_dir):
    return motif.motif_scan(sequences(spark, sf_dir), MOTIFS)


@query(f"""
WITH {SEQS}, {MOTIF_SQL}, m AS (SELECT seq_id, seq, name, pattern FROM seqs JOIN motifs ON contains(seq, pattern)),
p AS (SELECT seq_id, name, seq, pattern, unnest(range(1, length(seq) - length(pattern) + 2)) AS i FROM m)
SELECT seq_id, name, i AS start, i + length(pattern) - 1 AS "end" FROM p WHERE substr(seq, i, length(pattern)) = pattern
""")
def motif_positions(spark, sf_dir):
    return motif.motif_positions(sequences(spark, sf_dir), MOTIFS)


@query(f"""
WITH {SEQS}, {MOTIF_SQL}, both_(name, strand, pattern) AS (SELECT name, '+', pattern FROM motifs UNION ALL SELECT name, '-', reverse(translate(pattern, 'ATGC', 'TACG')) FROM motifs),
p AS (SELECT seq_id, name, strand, seq, pattern, unnest(range(1, length(seq) - length(pattern) + 2)) AS i FROM seqs JOIN both_ ON contains(seq, pattern))
SELECT seq_id, name, strand, i AS start, i + length(pattern) - 1 AS "end" FROM p WHERE substr(seq, i, length(pattern)) = pattern
""")
def motif_strands(spark, sf_dir):
    return motif.motif_strands(sequences(spark, sf_dir), MOTIFS)


HITS = f"""WITH {SEQS}, {REFS},
st AS (SELECT ref_id, '+' AS strand, seq FROM refs UNION ALL SELECT ref_id, '-', reverse(translate(seq, 'ATGC', 'TACG')) FROM refs),
db AS (SELECT ref_id, strand, i - 1 AS s_pos, substr(seq, i, 16) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 14)) AS i FROM st WHERE length(seq) >= 16)),

qk AS (SELECT seq_id, i - 1 AS pos, substr(seq, i, 16) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 14)) AS i FROM seqs WHERE length(seq) >= 16)),
sd AS (SELECT seq_id, ref_id, strand, pos, pos - s_pos AS diag FROM qk JOIN db USING (kmer)),
mk AS (SELECT *, CASE WHEN coalesce(pos - (lag(pos) OVER w + 16), 17) > 16 THEN 1 ELSE 0 END AS nw FROM sd WINDOW w AS (PARTITION BY seq_id, ref_id, strand, diag ORDER BY pos)),
il AS (SELECT *, sum(nw) OVER (PARTITION BY seq_id, ref_id, strand, diag ORDER BY pos) AS island FROM mk),
sp AS (SELECT seq_id, ref_id, strand, diag, min(pos) AS a, max(pos) + 16 AS z FROM il GROUP BY seq_id, ref_id, strand, diag, island),
ct AS (SELECT sp.*, z - a AS n, length(q.seq) AS q_len, length(s.seq) AS s_len, substr(q.seq, a + 1, z - a) AS x, substr(s.seq, a - diag + 1, z - a) AS y FROM sp JOIN seqs q USING (seq_id) JOIN st s USING (ref_id, strand)),
mt AS (SELECT *, len(list_filter(range(1, n + 1), lambda i: substr(x, i, 1) = substr(y, i, 1))) AS m FROM ct),
sc AS (SELECT *, m - 2 * (n - m) AS score, 0.621 * q_len * (SELECT sum(length(seq)) FROM refs)::DOUBLE * exp(-1.33 * (m - 2 * (n - m))) AS e FROM mt),
hits AS (SELECT seq_id AS query_id, ref_id AS subject_id, m / n * 100 AS percent_identity, n AS alignment_length, n - m AS mismatches, 0::BIGINT AS gap_opens, a + 1 AS q_start, z AS q_end,
 CASE WHEN strand = '+' THEN a - diag + 1 ELSE s_len - (a - diag) END AS s_start, CASE WHEN strand = '+' THEN z - diag ELSE s_len + 1 - (z - diag) END AS s_end, e AS evalue, (1.33 * score - ln(0.621)) / ln(2) AS bit_score FROM sc WHERE e <= 1e-5)"""


def hits(spark, sf_dir):
    return homology.homology_hits(sequences(spark, sf_dir), references(spark, sf_dir))


@query(f"{HITS} SELECT query_id, subject_id, round(percent_identity, 6) AS percent_identity, alignment_length, mismatches, gap_opens, q_start, q_end, s_start, s_end, round(evalue, 6) AS evalue, round(bit_score, 6) AS bit_score FROM hits")
def homology_hits(spark, sf_dir):
    return hits(spark, sf_dir)


@query()
def gapped_hits(spark, sf_dir):
    """Local alignments with gaps, on both strands; tests hold them against full dynamic programs. In the driver's texts N is a letter."""
    return gapped.gapped_hits(sequences(spark, sf_dir), references(spark, sf_dir), n_counts=True)


@query()
def gapped_coverage(spark, sf_dir):
    return homology.coverage(gapped_hits(spark, sf_dir), sequences(spark, sf_dir).select("seq_id", F.length("seq").alias("len")))


@query(f"{HITS}, pos AS (SELECT DISTINCT query_id, unnest(range(q_start, q_end + 1)) AS p FROM hits), c AS (SELECT query_id, count(*) AS covered FROM pos GROUP BY 1) SELECT seq_id, coalesce(covered, 0) AS covered, round(coalesce(covered / nullif(length(seq), 0) * 100, 0), 6) AS coverage FROM seqs LEFT JOIN c ON query_id = seq_id")
def hit_coverage(spark, sf_dir):
    return homology.coverage(hits(spark, sf_dir), sequences(spark, sf_dir).select("seq_id", F.length("seq").alias("len")))


SUMMARY = "best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY percent_identity DESC, subject_id, q_start) AS k, count(*) OVER (PARTITION BY query_id) AS n_hits FROM hits), summ AS (SELECT seq_id, coalesce(n_hits, 0) AS n_hits, coalesce(percent_identity, 0) AS max_identity, subject_id AS top_subject FROM seqs LEFT JOIN best ON query_id = seq_id AND k = 1)"


@query(f"{HITS}, {SUMMARY} SELECT seq_id, n_hits, round(max_identity, 6) AS max_identity, top_subject FROM summ")
def hit_summary(spark, sf_dir):
    return homology.hit_summary(hits(spark, sf_dir), sequences(spark, sf_dir))


@query(f"{HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY q_start, q_end, subject_id, s_start) AS n FROM hits) SELECT query_id, n, subject_id, q_start, q_end, substr(seq, q_start, least(70, q_end - q_start + 1)) AS snippet FROM r JOIN seqs ON seq_id = query_id WHERE n <= 35")
def hit_listing(spark, sf_dir):
    return homology.hit_listing(hits(spark, sf_dir), sequences(spark, sf_dir))


@query(f"{HITS} SELECT seq_id, seq_id IN (SELECT query_id FROM hits) AS hit FROM seqs")
def hit_flag(spark, sf_dir):
    return homology.has_hit(sequences(spark, sf_dir).select("seq_id"), hits(spark, sf_dir).select(F.col("query_id").alias("id")))


# ranks, curves, tables


@query(f"{BASE}, {BINARY}, r AS (SELECT score, x, rank() OVER (PARTITION BY score ORDER BY x) + (count(*) OVER (PARTITION BY score, x) - 1) / 2 AS midrank FROM pts) SELECT score, x, midrank, count(*) AS n FROM r GROUP BY ALL")
def midrank(spark, sf_dir):
    return metrics.midranks(binary(spark, sf_dir), ("score",)).groupBy("score", "x", "midrank").agg(F.count(F.lit(1)).alias("n"))


AUC = "won AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY score ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS u FROM cnt)"


@query(f"{BASE}, {BINARY}, {CUM}, {AUC} SELECT score, sum(pos)::BIGINT AS m, sum(neg)::BIGINT AS n, round(sum(u) / (sum(pos) * sum(neg)), 6) AS auroc FROM won GROUP BY score")
def auroc(spark, sf_dir):
    return metrics.auroc(binary(spark, sf_dir), ("score",))


OVR = "pts AS (SELECT c AS score, CASE WHEN label = c THEN 1 ELSE 0 END AS y, CASE c WHEN 0 THEN 1 - gc WHEN 1 THEN ns ELSE gc END AS x FROM scored CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS c))"


def three(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("inverse", 1 - F.col("gc"))
    return metrics.one_vs_rest(s, [0, 1, 2], {0: "inverse", 1: "ns", 2: "gc"})


@query(f"{BASE}, {OVR}, {CUM}, {AUC} SELECT score AS class, sum(pos)::BIGINT AS m, sum(neg)::BIGINT AS n, round(sum(u) / (sum(pos) * sum(neg)), 6) AS auroc FROM won GROUP BY score")
def auroc_ovr(spark, sf_dir):
    return metrics.auroc(three(spark, sf_dir), ("class",))


@query(f"{BASE}, {OVR}, {CUM}, {AUC}, a AS (SELECT score, sum(u) / (sum(pos) * sum(neg)) AS auroc FROM won GROUP BY score) SELECT round(avg(auroc), 6) AS macro_auroc FROM a")
def auroc_macro(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("inverse", 1 - F.col("gc"))
    return metrics.macro_auroc(s, [0, 1, 2], {0: "inverse", 1: "ns", 2: "gc"})


ROC = "roc AS (SELECT score, x, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY score) AS m, sum(neg) OVER (PARTITION BY score) AS n FROM cnt WINDOW w AS (PARTITION BY score ORDER BY x DESC))"


@query(f"{BASE}, {BINARY}, {CUM}, {ROC} SELECT score, x, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / m, 6) AS tpr, round(fp / n, 6) AS fpr FROM roc")
def roc_points(spark, sf_dir):
    return metrics.roc_points(binary(spark, sf_dir), ("score",))


@query(f"{BASE}, {BINARY}, {CUM}, {ROC}, st AS (SELECT score, m, n, (tp / m - coalesce(lag(tp / m) OVER (PARTITION BY score ORDER BY x DESC), 0)) * tp / (tp + fp) AS s FROM roc) SELECT score, round(sum(s), 6) AS ap, round(max(m) / (max(m) + max(n)), 6) AS base FROM st GROUP BY score")
def average_precision(spark, sf_dir):
    return metrics.average_precision(binary(spark, sf_dir), ("score",))


DELONG = """pl AS (SELECT score, x, pos, neg, sum(pos) OVER (PARTITION BY score) AS m, sum(neg) OVER (PARTITION BY score) AS n, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb FROM cnt WINDOW w AS (PARTITION BY score ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
vu AS (SELECT *, (nb + neg / 2) / n AS v, 1 - (pb + pos / 2) / m AS u FROM pl),
dl AS (SELECT score, max(m)::BIGINT AS m, max(n)::BIGINT AS n, sum(pos * v) / max(m) AS auroc,
 (sum(pos * v * v) - sum(pos * v) * sum(pos * v) / max(m)) / (max(m) - 1) / max(m) + (sum(neg * u * u) - sum(neg * u) * sum(neg * u) / max(n)) / (max(n) - 1) / max(n) AS variance FROM vu GROUP BY score)"""


@query(f"{BASE}, {OVR}, {CUM}, {DELONG} SELECT score AS class, m, n, round(auroc, 6) AS auroc, round(variance, 6) AS variance, round(greatest(auroc - 1.959963984540054 * sqrt(variance), 0), 6) AS lo, round(least(auroc + 1.959963984540054 * sqrt(variance), 1), 6) AS hi FROM dl")
def delong_ci(spark, sf_dir):
    return metrics.delong(three(spark, sf_dir), ("class",))


@query(f"""{BASE}, tr AS (SELECT ns AS x FROM scored WHERE label = 0), te AS (SELECT seq_id, ns AS x FROM scored WHERE label <> 0)
SELECT seq_id, x, round(((SELECT count(*) FROM tr WHERE tr.x < te.x) + (SELECT count(*) FROM tr WHERE tr.x <= te.x) + (SELECT max(CASE WHEN tr.x = te.x THEN 1 ELSE 0 END) FROM tr)) / (2 * (SELECT count(*) FROM tr)), 6) AS risk FROM te""")
def ecdf_risk(spark, sf_dir):
    s = scored(spark, sf_dir).select("seq_id", "label", F.col("ns").alias("x"))
    return metrics.ecdf_risk(s.filter("label = 0").select("x"), s.filter("label <> 0").select("seq_id", "x"))


PRED = "pred AS (SELECT label AS y, CASE WHEN ns >= 0.4 THEN 1 WHEN gc >= 0.12 THEN 2 ELSE 0 END AS p FROM scored), cells AS (SELECT a.c AS y, b.c AS p, count(pred.y) AS n FROM (SELECT unnest([0, 1, 2]) AS c) a CROSS JOIN (SELECT unnest([0, 1, 2]) AS c) b LEFT JOIN pred ON pred.y = a.c AND pred.p = b.c GROUP BY ALL)"


def predicted(spark, sf_dir):
    return scored(spark, sf_dir).select(F.col("label").alias("y"), F.when(F.col("ns") >= 0.4, 1).when(F.col("gc") >= 0.12, 2).otherwise(0).alias("p"))


@query(f"{BASE}, {PRED} SELECT y::BIGINT AS y, p::BIGINT AS p, n, round(n / greatest(sum(n) OVER (PARTITION BY y), 1), 6) AS share FROM cells")
def confusion(spark, sf_dir):
    return metrics.confusion(predicted(spark, sf_dir), [0, 1, 2])


REPORT = """rep AS (SELECT c.c, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(sup, 0), 0) AS recall, coalesce(2 * tp / nullif(said + sup, 0), 0) AS f1, sup AS support FROM (SELECT unnest([0, 1, 2]) AS c) c
 JOIN (SELECT y, sum(n)::BIGINT AS sup, sum(CASE WHEN y = p THEN n ELSE 0 END)::BIGINT AS tp FROM cells GROUP BY y) a ON a.y = c.c JOIN (SELECT p, sum(n)::BIGINT AS said FROM cells GROUP BY p) b ON b.p = c.c)"""


@query(f"{BASE}, {PRED}, {REPORT} SELECT c::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep UNION ALL SELECT 'MACRO', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM rep")
def class_report(spark, sf_dir):
    return metrics.class_report(predicted(spark, sf_dir), [0, 1, 2])


@query(f"{BASE}, {PRED}, r AS (SELECT y, sum(n) AS s, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM cells GROUP BY y), o AS (SELECT sum(tp) / sum(s) AS accuracy, avg(tp / greatest(s, 1)) AS mean_recall, min(s) = max(s) AS balanced FROM r) SELECT round(accuracy, 6) AS accuracy, round(mean_recall, 6) AS mean_recall, balanced, CASE WHEN NOT balanced THEN 'warn' WHEN abs(mean_recall - accuracy) < 0.01 THEN 'ok' ELSE 'fail' END AS verdict FROM o")
def accuracy_check(spark, sf_dir):
    return metrics.accuracy_check(predicted(spark, sf_dir), [0, 1, 2])


THRESHOLDS = [round(0.10 + 0.05 * i, 2) for i in range(18)]
SWEEP = f"""th AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold),
sw AS (SELECT score, threshold, sum(CASE WHEN y = 1 AND x >= threshold THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN y = 0 AND x >= threshold THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN y = 1 AND x < threshold THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN y = 0 AND x < threshold THEN 1 ELSE 0 END)::BIGINT AS tn FROM pts CROSS JOIN th GROUP BY ALL),
rt AS (SELECT *, tp / greatest(tp + fn, 1) AS tpr, fp / greatest(fp + tn, 1) AS fpr, tp / greatest(tp + fp, 1) AS precision FROM sw),
fs AS (SELECT *, 2 * precision * tpr / greatest(precision + tpr, 1e-9) AS f1 FROM rt)"""
SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("tpr", "fpr", "precision", "f1"))


@query(f"{BASE}, {BINARY}, {SWEEP} SELECT score, threshold, tp, fp, fn, tn, {SIX} FROM fs")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(binary(spark, sf_dir), THRESHOLDS, ("score",))


@query(f"{BASE}, {BINARY}, {SWEEP}, b AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY f1 DESC, threshold) AS k FROM fs) SELECT score, threshold, tp, fp, fn, tn, {SIX} FROM b WHERE k = 1")
def peak_f1(spark, sf_dir):
    return metrics.peak_f1(metrics.threshold_sweep(binary(spark, sf_dir), THRESHOLDS, ("score",)), ("score",))


@query(f"{BASE}, h AS (SELECT label, least(floor(ns * 100 / 5)::BIGINT + 1, 20) AS bin FROM scored), c AS (SELECT label, bin, count(*) AS n FROM h GROUP BY ALL) SELECT label::BIGINT AS label, bin, n, round(n / (sum(n) OVER (PARTITION BY label) * 5), 6) AS density FROM c")
def score_hist(spark, sf_dir):
    return metrics.histogram(scored(spark, sf_dir).select("label", (F.col("ns") * 100).alias("x")), ("label",))


@query(f"{BASE} SELECT label::BIGINT AS label, round(avg(ns), 6) AS mean, round(stddev_pop(ns), 6) AS std, round(min(ns), 6) AS min, round(max(ns), 6) AS max, count(*) AS n FROM scored GROUP BY label")
def score_distribution(spark, sf_dir):
    return metrics.distribution(scored(spark, sf_dir), ("label",), "ns")


@query(f'{BASE} SELECT label::BIGINT AS label, round(min(ns), 6) AS "min", round(quantile_cont(ns, 0.25), 6) AS q1, round(quantile_cont(ns, 0.5), 6) AS median, round(quantile_cont(ns, 0.75), 6) AS q3, round(max(ns), 6) AS "max" FROM scored GROUP BY label')
def box_summary(spark, sf_dir):
    return metrics.box_summary(scored(spark, sf_dir), ("label",), "ns")


@query(f"WITH {LABELS} SELECT label::BIGINT AS label, count(*) AS n FROM lab GROUP BY label")
def class_counts(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# tests, folds, samples

TOOLS = "tools AS (SELECT y, CASE WHEN ns >= 0.4 THEN 1 ELSE 0 END AS own, CASE WHEN gc >= 0.1 THEN 1 ELSE 0 END AS by_gc, CASE WHEN ns >= 0.3 THEN 1 ELSE 0 END AS by_n FROM scored), long AS (SELECT 'by_gc' AS tool, y, own AS a, by_gc AS b FROM tools UNION ALL SELECT 'by_n', y, own, by_n FROM tools)"


def tools(spark, sf_dir):
    return scored(spark, sf_dir).select("y", (F.col("ns") >= 0.4).cast("int").alias("own"), (F.col("gc") >= 0.1).cast("int").alias("by_gc"), (F.col("ns") >= 0.3).cast("int").alias("by_n"))


@query(f"""{BASE}, {TOOLS}, c AS (SELECT tool, sum(CASE WHEN a = y AND b = y THEN 1 ELSE 0 END)::BIGINT AS n11, sum(CASE WHEN a = y AND b <> y THEN 1 ELSE 0 END)::BIGINT AS n10, sum(CASE WHEN a <> y AND b = y THEN 1 ELSE 0 END)::BIGINT AS n01, sum(CASE WHEN a <> y AND b <> y THEN 1 ELSE 0 END)::BIGINT AS n00 FROM long GROUP BY tool),
x AS (SELECT *, coalesce((abs(n10 - n01) - 1) * (abs(n10 - n01) - 1) / nullif(n10 + n01, 0), 0) AS chi2 FROM c), t AS (SELECT *, sqrt(chi2 / 2) AS z, 1 / (1 + 0.3275911::DOUBLE * sqrt(chi2 / 2)) AS t FROM x),
p AS (SELECT *, round(CASE WHEN n10 + n01 = 0 THEN 1 ELSE ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-z * z) END, 4) AS p FROM t) SELECT tool, n11, n10, n01, n00, round(chi2, 6) AS chi2, p, p < 0.05 AS significant, count(*) OVER (PARTITION BY round(chi2, 2)) AS twins FROM p""")
def mcnemar(spark, sf_dir):
    return stats.mcnemar_suite(tools(spark, sf_dir), ["by_gc", "by_n"], "own")


@query(f"""{BASE}, {TOOLS}, c AS (SELECT tool, 'accuracy' AS rate, sum(CASE WHEN b = y THEN 1 ELSE 0 END)::BIGINT AS k, count(*) AS n FROM long GROUP BY tool UNION ALL SELECT tool, 'tpr', sum(CASE WHEN b = 1 AND y = 1 THEN 1 ELSE 0 END)::BIGINT, sum(y)::BIGINT FROM long GROUP BY tool UNION ALL SELECT tool, 'fpr', sum(CASE WHEN b = 1 AND y = 0 THEN 1 ELSE 0 END)::BIGINT, sum(1 - y)::BIGINT FROM long GROUP BY tool),
p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM c), q AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS center, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM p)
SELECT tool, rate, k, n, round(p, 6) AS value, round(greatest(center - h, 0), 6) AS lo, round(least(center + h, 1), 6) AS hi, round(center, 6) AS center FROM q""")
def wilson_rates(spark, sf_dir):
    t = tools(spark, sf_dir)
    long = t.select("y", F.explode(F.array(*(F.struct(F.lit(n).alias("tool"), F.col(n).alias("p")) for n in ("by_gc", "by_n")))).alias("t")).select("y", "t.*")
    return stats.rates(long, ("tool",))


@query(f"""WITH {SEQS}, {LABELS}, v AS (SELECT source, label, count(*) AS c FROM seqs JOIN lab USING (seq_id) GROUP BY ALL), g AS (SELECT substr(source, 4)::BIGINT AS grp, label, c FROM v),
o AS (SELECT grp, label, sum(c) OVER (PARTITION BY grp) AS size, row_number() OVER (PARTITION BY grp ORDER BY c DESC, label) AS k FROM g),
r AS (SELECT grp, label, (row_number() OVER (PARTITION BY label ORDER BY size DESC, (grp * 2654435761 + 42) % 1000003, grp) - 1) % 10 AS k FROM o WHERE k = 1)
SELECT grp, label::BIGINT AS label, CASE WHEN k < 5 THEN k ELSE 9 - k END AS fold FROM r""")
def group_folds(spark, sf_dir):
    rows = sequences(spark, sf_dir).join(labels(spark, sf_dir), "seq_id").select(F.substring("source", 4, 20).cast("long").alias("grp"), "label")
    return folds.group_folds(rows, "grp", "label")


@query(f"WITH {LABELS}, r AS (SELECT seq_id, label, row_number() OVER (PARTITION BY label ORDER BY (seq_id * 2654435761 + 42) % 1000003, seq_id) AS k FROM lab) SELECT seq_id, label::BIGINT AS label FROM r WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM lab GROUP BY label))")
def balanced_sample(spark, sf_dir):
    return folds.balanced_sample(labels(spark, sf_dir), "label", "seq_id")


@query(f"WITH {SEQS}, r AS (SELECT seq_id, source, length(seq) AS len, row_number() OVER (PARTITION BY source ORDER BY seq_id) AS k FROM seqs) SELECT seq_id, source, len FROM r WHERE k <= 20")
def first_per_source(spark, sf_dir):
    return folds.first_per_group(sequences(spark, sf_dir).select("seq_id", "source", F.length("seq").alias("len")), "source", ["seq_id"], 20)


@query(f"WITH {SEQS}, r AS (SELECT md5(seq) AS digest, seq_id, length(seq) AS len, row_number() OVER (PARTITION BY md5(seq) ORDER BY len DESC, seq_id) AS k FROM (SELECT *, length(seq) AS len FROM seqs)) SELECT digest, seq_id, len FROM r WHERE k = 1")
def first_by_sequence(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.md5(F.col("seq").cast("binary")).alias("digest"), "seq_id", F.length("seq").alias("len"))
    return folds.first_by_id(s, "digest", ["seq_id"])


@query(f"""WITH {SEQS}, u AS (SELECT seq_id, seq FROM seqs WHERE length(seq) >= 20), h AS (SELECT seq_id, row_number() OVER (ORDER BY (seq_id * 2654435761 + 42) % 1000003, seq_id) - 1 AS no FROM u), t AS (SELECT count(*) AS total FROM u),
d AS (SELECT i AS id, (((i * 2654435761 + 42) % 1000003) * 7919 + i) % total AS no, (i * 2654435761 + 53) % 1000003 AS u, (i * 2654435761 + 71) % 1000003 AS v FROM range(0, 500) r(i) CROSS JOIN t),
s AS (SELECT d.*, seq_id, seq, 20 + d.u % (least(150, length(seq)) - 19) AS size FROM d JOIN h USING (no) JOIN u USING (seq_id))
SELECT 'frag_' || lpad(id::VARCHAR, 6, '0') AS frag_id, seq_id, substr(seq, v % (length(seq) - size + 1) + 1, size) AS frag FROM s""")
def sampled_fragments(spark, sf_dir):
    return seq.sampled_fragments(sequences(spark, sf_dir), 500)


# evidence, verdicts, fusion. The risk of a record stands for a classifier's: 100 x its share of N; the anomaly for the
# envelope's: 300 x its share of G and C.

RISK = "least(round(ns * 100, 6), 100)"
OOD = "least(round(gc * 300, 6), 100)"
MOT = f"{MOTIF_SQL}, mot AS (SELECT seq_id, count(*) AS n_motifs FROM seqs JOIN motifs ON contains(seq, pattern) GROUP BY 1)"
ALLS = f"alls AS (SELECT seq_id, length(seq) AS len, round(coalesce({n_of('GC')} / nullif(length(seq), 0), 0), 6) AS gc, round(coalesce({n_of('N')} / nullif(length(seq), 0), 0), 6) AS ns, round(coalesce({n_of('GC')} / nullif({n_of('ATGC')}, 0) * 100, 0), 6) AS gc_percent FROM seqs)"
SIG = f"sig AS (SELECT seq_id, len, gc_percent, {RISK} AS risk, {OOD} AS ood, n_hits, max_identity, coalesce(n_motifs, 0) AS n_motifs FROM alls JOIN summ USING (seq_id) LEFT JOIN mot USING (seq_id))"
SIGNALS = f"{HITS}, {SUMMARY}, {MOT}, {ALLS}, {SIG}"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: len, gc_percent, risk, ood, n_hits, max_identity, top_subject, n_motifs."""
    s = sequences(spark, sf_dir)
    share = lambda x: F.round(F.coalesce(T.letters("seq", x) / F.nullif(F.length("seq"), F.lit(0)), F.lit(0.0)), 6)
    base = s.select("seq_id", F.length("seq").alias("len"), F.round(T.gc_percent("seq"), 6).alias("gc_percent"), F.least(F.round(share("N") * 100, 6), F.lit(100.0)).alias("risk"), F.least(F.round(share("GC") * 300, 6), F.lit(100.0)).alias("ood"))
    found = motif.motif_scan(s, MOTIFS).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_motifs"))
    out = base.join(homology.hit_summary(hits(spark, sf_dir), s), "seq_id").join(found, "seq_id", "left")
    return out.withColumn("n_motifs", F.coalesce("n_motifs", F.lit(0)))


VERDICT = "CASE WHEN n_hits > 0 OR n_motifs > 0 THEN 'CONFIRMED LAB-ENGINEERED' WHEN len > 0 AND len < 20 THEN 'BORDERLINE / REVIEW' WHEN risk >= 60{0} THEN 'SUSPECTED ENGINEERED' WHEN risk >= 35{1} THEN 'BORDERLINE / REVIEW' ELSE 'LIKELY NATURAL' END"


@query(f"{SIGNALS} SELECT seq_id, {VERDICT.format('', '')} AS verdict, {VERDICT.format(' AND ood >= 5', ' AND ood >= 2')} AS dual FROM sig")
def verdict(spark, sf_dir):
    s = signals(spark, sf_dir)
    args = [F.col(c) for c in ("n_hits", "n_motifs", "risk", "len")]
    return s.select("seq_id", evidence.verdict(*args).alias("verdict"), evidence.verdict(*args, ood=F.col("ood")).alias("dual"))


CODON_REC = codon_sql("seq_id", "seqs") + ", used AS (SELECT seq_id, round(avg(abs(rscu - 1)), 4) AS bias FROM rscu GROUP BY ALL)"
ENRICH = """km6 AS (SELECT seq_id, substr(seq, i, 6) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 4)) AS i FROM seqs WHERE length(seq) >= 6)),
cnt6 AS (SELECT seq_id, kmer, count(*) AS cnt FROM km6 GROUP BY ALL), tot6 AS (SELECT seq_id, count(*) AS total FROM km6 GROUP BY ALL),
bgs AS (SELECT seq_id, substr(seq, 1, 50000) AS seq FROM seqs WHERE length(seq) >= 4 ORDER BY seq_id LIMIT 20),
bk AS (SELECT substr(seq, i, 6) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS i FROM bgs WHERE length(seq) >= 6)),
bg AS (SELECT kmer, count(*) AS bg FROM bk GROUP BY ALL), bt AS (SELECT count(*) AS bg_total FROM bk),
enr AS (SELECT seq_id, max((cnt / total) / ((coalesce(bg, 0) + 1) / (bg_total + 4096))) AS fold FROM cnt6 JOIN tot6 USING (seq_id) LEFT JOIN bg USING (kmer) CROSS JOIN bt GROUP BY seq_id)"""
LEVELS = """lv AS (SELECT sig.*, coalesce(cai, 0) AS cai, coalesce(bias, 0) AS bias, coalesce(fold, 0) AS max_fold,
 CASE WHEN risk >= 80 THEN 'CRITICAL' WHEN risk >= 60 THEN 'HIGH' WHEN risk >= 35 THEN 'MODERATE' WHEN risk >= 15 THEN 'LOW' ELSE 'NEGATIVE' END AS ai,
 CASE WHEN ood >= 75 THEN 'CRITICAL' WHEN ood >= 50 THEN 'HIGH' WHEN ood >= 35 THEN 'MODERATE' WHEN ood >= 20 THEN 'LOW' ELSE 'NEGATIVE' END AS ood_level,
 CASE WHEN n_hits = 0 THEN 'NEGATIVE' WHEN n_hits >= 10 AND max_identity >= 95 THEN 'CRITICAL' WHEN n_hits >= 5 AND max_identity >= 90 THEN 'HIGH' WHEN n_hits >= 2 AND max_identity >= 85 THEN 'MODERATE' ELSE 'LOW' END AS blast,
 CASE WHEN n_motifs > 0 THEN 'CRITICAL' WHEN fold >= 20 THEN 'HIGH' WHEN fold >= 10 THEN 'MODERATE' WHEN fold IS NOT NULL THEN 'LOW' ELSE 'NEGATIVE' END AS motifs,
 CASE WHEN cai > 0.75 OR bias > 0.5 THEN 'HIGH' WHEN cai > 0.65 OR bias > 0.45 THEN 'MODERATE' WHEN cai > 0.55 OR bias > 0.3 THEN 'LOW' ELSE 'NEGATIVE' END AS codon,
 CASE WHEN gc_percent < 30 OR gc_percent > 65 THEN 'MODERATE' WHEN gc_percent < 35 OR gc_percent > 60 THEN 'LOW' ELSE 'NEGATIVE' END AS gc
 FROM sig LEFT JOIN cai USING (seq_id) LEFT JOIN used USING (seq_id) LEFT JOIN enr USING (seq_id))"""
FULL = f"{SIGNALS}, {CODON_REC}, {ENRICH}, {LEVELS}"


def leveled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """signals() with codon use and enrichment, and the strengths of the six signals."""
    s = sequences(spark, sf_dir)
    folded = motif.enriched_kmers(s, top=1).select("seq_id", "fold")
    used = codon.codon_summary(s).select("seq_id", "cai", "bias", F.col("flag").alias("codon_flag"))
    rows = signals(spark, sf_dir).join(used, "seq_id").join(folded, "seq_id", "left")
    return rows, evidence.strengths(*(F.col(c) for c in ("risk", "ood", "n_hits", "max_identity", "n_motifs", "fold", "cai", "bias", "gc_percent")))


@query(f"{FULL} SELECT seq_id, ai, ood_level AS ood, blast, motifs, codon, gc FROM lv")
def signal_strengths(spark, sf_dir):
    rows, s = leveled(spark, sf_dir)
    return rows.select("seq_id", *(c.alias(n) for n, c in s.items()))


@query(f"""{FULL} SELECT seq_id, concat_ws(',', CASE WHEN blast IN ('CRITICAL', 'HIGH') AND ai = 'NEGATIVE' THEN 'blast_ai' END, CASE WHEN ai IN ('CRITICAL', 'HIGH') AND ood_level IN ('NEGATIVE', 'LOW') THEN 'ai_ood' END, CASE WHEN ood_level IN ('CRITICAL', 'HIGH') AND ai IN ('NEGATIVE', 'LOW') THEN 'ood_ai' END, CASE WHEN codon IN ('HIGH', 'MODERATE') AND ai = 'NEGATIVE' THEN 'codon_ai' END, CASE WHEN len < 300 THEN 'short' END) AS conflicts,
 concat_ws(',', CASE WHEN (ai IN ('CRITICAL', 'HIGH'))::INT + (ood_level IN ('CRITICAL', 'HIGH'))::INT + (blast IN ('CRITICAL', 'HIGH'))::INT + (motifs IN ('CRITICAL', 'HIGH'))::INT + (codon IN ('CRITICAL', 'HIGH'))::INT >= 3 THEN 'strong' END, CASE WHEN ai IN ('CRITICAL', 'HIGH') AND ood_level IN ('CRITICAL', 'HIGH') THEN 'ai_ood' END, CASE WHEN blast IN ('CRITICAL', 'HIGH') AND motifs IN ('CRITICAL', 'HIGH') THEN 'blast_motif' END) AS convergence,
 CASE WHEN ood >= 75 THEN 'Anomalous' WHEN ood >= 50 THEN 'Elevated' WHEN ood >= 35 THEN 'Borderline' ELSE 'Normal' END AS ood_text FROM lv""")
def conflicts(spark, sf_dir):
    rows, s = leveled(spark, sf_dir)
    return rows.select("seq_id", F.concat_ws(",", evidence.conflicts(s, F.col("len"))).alias("conflicts"), F.concat_ws(",", evidence.convergence(s)).alias("convergence"), evidence.ood_level(F.col("ood")).alias("ood_text"))


@query(f"""{SIGNALS}, {CODON_REC}, e AS (SELECT seq_id, n_hits, n_motifs, risk / 100 AS kmer, ood / 100 AS ood, CASE WHEN n_hits > 0 THEN 1.0 ELSE 0 END::DOUBLE AS blast, least(1, n_motifs / 3)::DOUBLE AS motif, CASE WHEN coalesce(cai, 0) > 0.65 OR coalesce(bias, 0) > 0.45 THEN 1 ELSE 0 END::DOUBLE AS codon FROM sig LEFT JOIN cai USING (seq_id) LEFT JOIN used USING (seq_id))
SELECT seq_id, round(CASE WHEN blast >= 1 OR motif > 0 THEN 1 ELSE kmer END, 9) AS cascade, round(round(0.60::DOUBLE * kmer + 0.2667::DOUBLE * least(n_hits / 10, 1), 9) + 1e-10, 4) AS benchmark, round(0.45::DOUBLE * kmer + 0.25::DOUBLE * ood + 0.15::DOUBLE * blast + 0.10::DOUBLE * motif + 0.05::DOUBLE * codon, 9) AS convex FROM e""", digits=9)
def fused_score(spark, sf_dir):
    used = codon.codon_summary(sequences(spark, sf_dir)).select("seq_id", F.col("flag").alias("codon_flag"))
    rows = signals(spark, sf_dir).join(used, "seq_id")
    e = evidence.engine_scores(*(F.col(c) for c in ("risk", "ood", "n_hits", "n_motifs", "codon_flag")))
    return rows.select("seq_id", evidence.fused_cascade(e["kmer"], e["blast"], e["motif"]).alias("cascade"), evidence.fused_benchmark(e["kmer"], F.col("n_hits")).alias("benchmark"), evidence.fused_convex(e, evidence.WEIGHTS).alias("convex"))


ABL = f"""{SIGNALS}, {LABELS}, lb AS (SELECT sig.*, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y, risk / 100 AS ai, ood / 100 AS od, n_hits > 0 AS hit, n_motifs > 0 AS motif FROM sig JOIN lab USING (seq_id)),
pts AS (SELECT 'full' AS score, y, CASE WHEN motif THEN greatest(CASE WHEN hit THEN greatest(ai, 0.95::DOUBLE) ELSE ai END, 0.85::DOUBLE) ELSE CASE WHEN hit THEN greatest(ai, 0.95::DOUBLE) ELSE ai END END AS x FROM lb
 UNION ALL SELECT 'no_ai', y, CASE WHEN hit OR motif THEN greatest(od, 0.85::DOUBLE) ELSE od END FROM lb UNION ALL SELECT 'no_ood', y, CASE WHEN hit THEN greatest(ai, 0.95::DOUBLE) ELSE ai END FROM lb
 UNION ALL SELECT 'no_blast_motif', y, (ai + od) / 2 FROM lb UNION ALL SELECT 'ai_only', y, ai FROM lb UNION ALL SELECT 'ood_only', y, od FROM lb UNION ALL SELECT 'random', y, (seq_id * 2654435761 + 42) % 1000003 / 1000003 FROM lb)"""


@query(f"""{ABL}, {CUM}, {AUC}, a AS (SELECT score, sum(u) / (sum(pos) * sum(neg)) AS auroc FROM won GROUP BY score),
sw AS (SELECT score, sum(CASE WHEN y = 1 AND x >= 0.6::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN y = 0 AND x >= 0.6::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN y = 1 AND x < 0.6::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN y = 0 AND x < 0.6::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS tn FROM pts GROUP BY score),
rt AS (SELECT *, tp / greatest(tp + fn, 1) AS tpr, fp / greatest(fp + tn, 1) AS fpr, tp / greatest(tp + fp, 1) AS precision FROM sw), fs AS (SELECT *, 2 * precision * tpr / greatest(precision + tpr, 1e-9) AS f1 FROM rt)
SELECT score AS config, round(auroc, 6) AS auroc, CASE WHEN score = 'full' THEN 0 ELSE round((SELECT auroc FROM a WHERE score = 'full') - auroc, 6) END AS drop, tp, fp, fn, tn, {SIX} FROM fs JOIN a USING (score)""")
def ablation_table(spark, sf_dir):
    rows = signals(spark, sf_dir).join(labels(spark, sf_dir), "seq_id")
    rows = rows.select("seq_id", (F.col("label") != 0).cast("int").alias("y"), "risk", "ood", (F.col("n_hits") > 0).alias("hit"), (F.col("n_motifs") > 0).alias("motif"))
    return evidence.ablation_table(staged(evidence.ablation_scores(rows, "seq_id"), "ablation"))


@query(f"{SIGNALS}, {LABELS} SELECT seq_id, round(max_identity, 6) AS identity, ood, CASE WHEN ood > 50 THEN 1 ELSE 0 END::BIGINT AS label, max_identity BETWEEN 0 AND 30 AND ood BETWEEN 50 AND 100 AS in_zone, ood >= 5 AS novel_screen, ood >= 50 AS novel_eval FROM sig")
def signal_gap(spark, sf_dir):
    s = signals(spark, sf_dir)
    zone = F.col("max_identity").between(0, 30) & F.col("ood").between(50, 100)
    return s.select("seq_id", F.col("max_identity").alias("identity"), "ood", (F.col("ood") > 50).cast("int").alias("label"), zone.alias("in_zone"), (F.col("ood") >= 5).alias("novel_screen"), (F.col("ood") >= 50).alias("novel_eval"))


ENGINES = ("ai", "od", "blast", "motif", "codon")
POINTS = evidence.simplex(len(ENGINES), 5)
GRID = ", ".join(f"({g}, {', '.join(f'{w / 5}::DOUBLE' for w in p)})" for g, p in enumerate(POINTS))
WEIGHTED = " + ".join(f"w_{e} * {e}" for e in ENGINES)
GRID_SQL = f"""{SIGNALS}, {LABELS}, {CODON_REC}, lb AS (SELECT CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y, risk / 100 AS ai, ood / 100 AS od, CASE WHEN n_hits > 0 THEN 1 ELSE 0 END::DOUBLE AS blast, least(1, n_motifs / 3)::DOUBLE AS motif,
 CASE WHEN coalesce(cai, 0) > 0.65 OR coalesce(bias, 0) > 0.45 THEN 1 ELSE 0 END::DOUBLE AS codon FROM sig JOIN lab USING (seq_id) LEFT JOIN cai USING (seq_id) LEFT JOIN used USING (seq_id)),
grid(score, {', '.join(f'w_{e}' for e in ENGINES)}) AS (VALUES {GRID}), pts AS (SELECT score, y, round(0 + {WEIGHTED}, 9) AS x FROM lb CROSS JOIN grid), {CUM}, {AUC}, a AS (SELECT score, sum(u) / (sum(pos) * sum(neg)) AS auroc FROM won GROUP BY score)"""
GRID_COLUMNS = "score::BIGINT AS grid, " + ", ".join(f"w_{e}" for e in ENGINES) + ", round(auroc, 6) AS auroc"


def engines(spark, sf_dir):
    used = codon.codon_summary(sequences(spark, sf_dir)).select("seq_id", F.col("flag").alias("codon_flag"))
    rows = signals(spark, sf_dir).join(labels(spark, sf_dir), "seq_id").join(used, "seq_id")
    e = evidence.engine_scores(*(F.col(c) for c in ("risk", "ood", "n_hits", "n_motifs", "codon_flag")))
    return rows.select((F.col("label") != 0).cast("int").alias("y"), *(c.alias(n) for n, c in zip(ENGINES, e.values(), strict=True)))


@query(f"{GRID_SQL} SELECT {GRID_COLUMNS} FROM a JOIN grid USING (score)")
def fusion_grid(spark, sf_dir):
    return evidence.fusion_grid(engines(spark, sf_dir), list(ENGINES))


@query(f"{GRID_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY auroc DESC, score) AS k, max(CASE WHEN {' AND '.join(f'w_{e} = 0.2::DOUBLE' for e in ENGINES)} THEN auroc END) OVER () AS equal FROM a JOIN grid USING (score)) SELECT {GRID_COLUMNS}, round(equal, 6) AS equal_auroc FROM r WHERE k = 1")
def fusion_best(spark, sf_dir):
    """The best weights beside the area that equal weights reach; these are on the grid, so it is never larger."""
    return evidence.best_weights(evidence.fusion_grid(engines(spark, sf_dir), list(ENGINES)), list(ENGINES))


# token weights

TOKENS = """k AS (SELECT unnest([4, 6, 8]) AS k), tk AS (SELECT seq_id, idx, k, i, 'k' || k || '_' || substr(frag, i, k) AS token FROM (SELECT seq_id, idx, frag, k, unnest(range(1, length(frag) - k + 2)) AS i FROM frags CROSS JOIN k WHERE length(frag) >= k)),
bi AS (SELECT seq_id, idx, token || ' ' || lead(token) OVER (PARTITION BY seq_id, idx ORDER BY k, i) AS token FROM tk),
tc AS (SELECT seq_id, idx, token, count(*) AS tf FROM (SELECT seq_id, idx, token FROM tk UNION ALL SELECT * FROM bi WHERE token IS NOT NULL) GROUP BY ALL),
vo AS (SELECT token, count(*) AS df, sum(tf)::BIGINT AS n FROM tc GROUP BY token HAVING count(*) >= 3 ORDER BY n DESC, token LIMIT 100000),
rw AS (SELECT seq_id, idx, token, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM frags)) / (1 + df)) + 1) AS w FROM tc JOIN vo USING (token)),
wt AS (SELECT seq_id, idx, token, w / sqrt(sum(w * w) OVER (PARTITION BY seq_id, idx)) AS weight FROM rw)"""


def token_fragments(spark, sf_dir):
    return seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq")).select("seq_id", "idx", "frag")


@query(f"WITH {SEQS}, {FRAGS}, {TOKENS} SELECT token, df FROM vo")
def vocabulary(spark, sf_dir):
    return features.most_frequent(features.term_statistics(token_fragments(spark, sf_dir), ("seq_id", "idx"), least=3))


def weighted(spark, sf_dir, **how):
    # read three times: cleaned and cut once
    frags, by = staged(token_fragments(spark, sf_dir), "token-fragments"), ("seq_id", "idx")
    return features.weights(frags, by, features.most_frequent(features.term_statistics(frags, by, least=3)), frags.count(), **how)


@query(f"WITH {SEQS}, {FRAGS}, {TOKENS} SELECT seq_id, idx, token, round(weight, 6) AS weight FROM wt", digits=None)
def tfidf_weights(spark, sf_dir):
    return weighted(spark, sf_dir, digits=6)


@query(f"WITH {SEQS}, {FRAGS}, {TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, idx ORDER BY round(weight, 9) DESC, token) AS rank FROM wt) SELECT seq_id, idx, rank, token, round(weight, 9) AS weight FROM r WHERE rank <= 5", digits=9)
def top_tokens(spark, sf_dir):
    return weighted(spark, sf_dir, top=5, digits=9)


@query(f"""WITH {SEQS}, {FRAGS}, km AS (SELECT seq_id, idx, substr(frag, i, 4) AS kmer FROM (SELECT seq_id, idx, frag, unnest(range(1, length(frag) - 2)) AS i FROM frags)), c AS (SELECT seq_id, idx, kmer, count(*) AS c FROM km WHERE kmer NOT LIKE '%N%' GROUP BY ALL),
f AS (SELECT seq_id, idx, kmer, c / sum(c) OVER (PARTITION BY seq_id, idx) AS freq FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, idx ORDER BY abs(freq - 0.00390625) DESC, kmer) AS rank FROM f)
SELECT seq_id, idx, kmer, rank, round(abs(freq - 0.00390625), 6) AS dev FROM r WHERE rank <= 5""")
def top_dimensions(spark, sf_dir):
    v = seq.kmer_vectors(seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq")), ("seq_id", "idx"))
    return features.anomalous_dimensions(v, ("seq_id", "idx")).select("seq_id", "idx", "kmer", "rank", "dev")


@query(f"{BASE}, f AS (SELECT avg(gc) AS mg, stddev_pop(gc) AS sg, avg(ns) AS mn, stddev_pop(ns) AS sn FROM scored WHERE label = 0) SELECT seq_id, round((gc - mg) / sg, 6) AS gc, round((ns - mn) / sn, 6) AS ns FROM scored, f")
def scaled_features(spark, sf_dir):
    """Every labelled record, scaled by mean and deviation of class 0."""
    s = scored(spark, sf_dir)
    return features.scaled(s.select("seq_id", "gc", "ns"), ["gc", "ns"], s.filter("label = 0"))


POISSON_SQL = " ".join(f"WHEN u < {p}::DOUBLE THEN {n}" for n, p in enumerate(stats.POISSON))


@query(f"""{BASE}, ct AS (SELECT y, ns AS x, count(*) AS c FROM scored GROUP BY ALL), rg AS (SELECT *, sum(c) OVER (PARTITION BY y ORDER BY x) AS t FROM ct),
rw AS (SELECT y, x, unnest(range((t - c)::BIGINT, t::BIGINT)) AS no FROM rg),
dh AS (SELECT b, y, x, (b * 7919 + no * 104729 + y * 31 + 42) % 1000003 AS h FROM rw CROSS JOIN range(0, 2000) g(b)),
dr AS (SELECT b, y, x, ((h * h + h * 2654435761) % 1000003) / 1000003 AS u FROM dh),
dn AS (SELECT b, y, x, CASE {POISSON_SQL} ELSE 7 END AS n FROM dr),
cnt AS (SELECT b AS score, x, sum(y * n)::BIGINT AS pos, sum((1 - y) * n)::BIGINT AS neg FROM dn WHERE n > 0 GROUP BY ALL), {ROC}, st AS (SELECT score, (tp / m - coalesce(lag(tp / m) OVER (PARTITION BY score ORDER BY x DESC), 0)) * tp / (tp + fp) AS s FROM roc), ap AS (SELECT score, sum(s) AS ap FROM st GROUP BY score)
SELECT round(quantile_cont(ap, 0.025), 6) AS ap_lo, round(quantile_cont(ap, 0.975), 6) AS ap_hi, count(*) AS n FROM ap""")
def bootstrap_ap(spark, sf_dir):
    return stats.bootstrap_ap(scored(spark, sf_dir).select("y", F.col("ns").alias("x")))


# models: no SQL; tests hold them against what they must find


def fragment_vectors(spark, sf_dir):
    return anomaly.vector_table(seq.whole_fragments(sequences(spark, sf_dir).select("seq_id", "seq")))


def envelope(spark, sf_dir) -> tuple[DataFrame, anomaly.Forest]:
    """Vectors of all fragments, written once, and a forest fitted on those of records labelled 0."""
    vectors = staged(fragment_vectors(spark, sf_dir), "vectors")
    return vectors, anomaly.fit_forest(labelled_vectors(spark, sf_dir, vectors, 0))


def labelled_vectors(spark, sf_dir, vectors: DataFrame, label: int) -> DataFrame:
    return vectors.join(labels(spark, sf_dir).filter(F.col("label") == label).select("seq_id"), "seq_id", "left_semi")


@query()
def iforest_scores(spark, sf_dir):
    vectors, forest = envelope(spark, sf_dir)
    return anomaly.record_scores(anomaly.raw_scores(vectors, forest))


def anchored(spark, sf_dir, vectors: DataFrame, forest: anomaly.Forest, own: int = 0) -> tuple[DataFrame, DataFrame]:
    """The records' mean scores, and the anchors of calibration: over the fragments of the forest's own class and of class 2."""
    scored_ = staged(anomaly.raw_scores(vectors, forest).select("seq_id", "raw"), "fragment-scores")
    known = scored_.join(labels(spark, sf_dir), "seq_id")
    return anomaly.record_scores(scored_), anomaly.anchors(known.filter(F.col("label") == own), known.filter("label = 2"))


@query()
def ood_calibrated(spark, sf_dir):
    """Calibrated score, flag and Platt probability (p, by the bounded engine) of every record, by the anchors of classes 0 and 2."""
    vectors, forest = envelope(spark, sf_dir)
    raw, cal = anchored(spark, sf_dir, vectors, forest)
    score = anomaly.calibrated(*(F.col(c) for c in ("raw", "mean", "std", "high", "direction")))
    out = sequences(spark, sf_dir).select("seq_id", F.length("seq").alias("len")).join(raw, "seq_id", "left").crossJoin(F.broadcast(cal)).withColumn("score", F.when(F.col("raw").isNotNull(), score))
    out = out.join(platt_scores(vectors, labels(spark, sf_dir)), "seq_id", "left")
    return out.select("seq_id", "raw", "score", anomaly.ood_flag(F.col("len"), F.col("score")).alias("flag"), "p")


def platt_scores(vectors: DataFrame, known: DataFrame) -> DataFrame:
    """The records' mean probabilities by the bounded engine."""
    return anomaly.bounded_engine(vectors, known).groupBy("seq_id").agg(F.avg("p").alias("p"))


@query()
def ood_platt(spark, sf_dir):
    """P(class 2 rather than 0) of every record, over its fragments, by the bounded engine: 300 trees and its own sample."""
    vectors = staged(fragment_vectors(spark, sf_dir), "vectors")
    return platt_scores(vectors, labels(spark, sf_dir))


def training(spark, sf_dir):
    """The labelled fragments."""
    return classify.training_fragments(sequences(spark, sf_dir).select("seq_id", "seq").join(labels(spark, sf_dir), "seq_id"))


@query()
def cv_predictions(spark, sf_dir):
    return classify.cross_validate(training(spark, sf_dir))


@query()
def cv_auroc(spark, sf_dir):
    return classify.fold_scores(classify.cross_validate(training(spark, sf_dir)))


def classified(spark, sf_dir):
    """p0..p2 of all records by a random forest on the labelled ones."""
    model = classify.fit_forest(training(spark, sf_dir))
    seqs = sequences(spark, sf_dir)
    scored_ = classify.fragment_probabilities(model, classify.training_fragments(seqs.select("seq_id", "seq")))
    return classify.record_probabilities(scored_, seqs.select("seq_id", F.length("seq").alias("len")))


@query()
def screen_risk(spark, sf_dir):
    p = F.array("p0", "p1", "p2")
    kinds = sequences(spark, sf_dir).select("seq_id", T.sequence_type("seq").alias("kind"))
    kind = F.col("kind")
    return classified(spark, sf_dir).join(kinds, "seq_id").select("seq_id", "p0", "p1", "p2", T.risk(p, F.col("len")).alias("risk"), T.typed_risk(p, kind)["risk"].alias("typed_risk"), T.argmax(p).alias("class"), T.majority(p).alias("majority"))


@query()
def isotonic_calibrated(spark, sf_dir):
    """Out-of-fold probabilities of every record, calibrated on the other folds."""
    return classify.calibrated_folds(classify.cross_validate(training(spark, sf_dir)))


@query()
def window_sweep(spark, sf_dir):
    return classify.window_sweep(sequences(spark, sf_dir).select("seq_id", "seq").join(labels(spark, sf_dir), "seq_id"))


@query()
def risk_track(spark, sf_dir):
    model = classify.fit_logistic(staged(training(spark, sf_dir), "training"))
    return classify.risk_track(sequences(spark, sf_dir).select("seq_id", "seq"), model)


@query()
def nested_auroc(spark, sf_dir):
    """Folds in which all features, oversampling and the forest are fitted on the training records; 50 trees and 100 of the envelope."""
    frags = seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq").join(labels(spark, sf_dir), "seq_id"))
    return nested.nested_scores(nested.nested_cv(frags, trees=50, envelope_trees=100))


@query()
def smote_rows(spark, sf_dir):
    return features.smote(scored(spark, sf_dir), "seq_id", "label", ["gc", "ns"])


@query()
def metrics_table(spark, sf_dir):
    """Report, AUROC with DeLong's interval, average precision with its bootstrap interval by class, and the accuracy, from
    out-of-fold predictions; MACRO and ACCURACY have rows of their own."""
    oof = classify.cross_validate(training(spark, sf_dir))
    said = oof.select(F.col("label").alias("y"), T.argmax(F.array("p0", "p1", "p2")).alias("p"))
    each = metrics.one_vs_rest(oof, classify.CLASSES, {c: f"p{c}" for c in classify.CLASSES})
    ci = metrics.delong(each, ("class",)).select(F.col("class").cast("string").alias("class"), "auroc", "lo", "hi")
    ap = metrics.average_precision(each, ("class",)).select(F.col("class").cast("string").alias("class"), F.col("ap").alias("auprc"))
    drawn = None
    for c in classify.CLASSES:
        one = stats.bootstrap_ap(each.filter(F.col("class") == c)).select(F.lit(str(c)).alias("class"), F.col("ap_lo").alias("auprc_lo"), F.col("ap_hi").alias("auprc_hi"))
        drawn = one if drawn is None else drawn.unionByName(one)
    report = metrics.class_report(said, classify.CLASSES).withColumn("accuracy", F.lit(None).cast("double"))
    total = said.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("support")).withColumn("class", F.lit("ACCURACY"))
    report = report.unionByName(total, allowMissingColumns=True)
    return report.join(ci, "class", "left").join(ap, "class", "left").join(drawn, "class", "left")


def named(weights: DataFrame, name: str, value: str) -> DataFrame:
    """The largest few of each record's fragments, as text: name=value, in order."""
    best = weights.groupBy("seq_id", name).agg(F.max(F.abs(value)).alias("_v")).withColumn("_n", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("_v"), name))).filter("_n <= 5")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.format_string("%s=%.3f", F.col(name), F.col("_v")).alias("t")))), lambda x: x["t"])
    return best.groupBy("seq_id").agg(F.array_join(parts, ", ").alias("named"))


def screened(spark: SparkSession, sf_dir: str, risk: DataFrame, ood: DataFrame) -> DataFrame:
    """The screening table of all records by risk(seq_id, risk) and ood(seq_id, ood); a record without a score has 0."""
    rows, strength = leveled(spark, sf_dir)
    out = rows.drop("risk", "ood").join(risk, "seq_id").join(ood, "seq_id", "left").withColumn("ood", F.coalesce("ood", F.lit(0.0)))
    e = evidence.engine_scores(*(F.col(c) for c in ("risk", "ood", "n_hits", "n_motifs", "codon_flag")))
    fused = evidence.fused_cascade(e["kmer"], e["blast"], e["motif"])
    frags = seq.fragments(sequences(spark, sf_dir).select("seq_id", "seq"))
    tokens = named(weighted(spark, sf_dir, top=5), "token", "weight").withColumnRenamed("named", "tokens")
    dims = named(features.anomalous_dimensions(seq.kmer_vectors(frags, ("seq_id", "idx")), ("seq_id", "idx")), "kmer", "dev").withColumnRenamed("named", "dims")
    out = out.join(tokens, "seq_id", "left").join(dims, "seq_id", "left")
    none = F.lit("none")
    text = evidence.evidence_text(F.col("seq_id"), e, fused, F.coalesce("tokens", none), F.coalesce("dims", none), F.coalesce(F.col("top_subject").cast("string"), F.lit("none")), F.concat(F.col("n_motifs").cast("string"), F.lit(" known")), F.col("bias"))
    return out.select("seq_id", "len", "gc_percent", "risk", "ood", "n_hits", "max_identity", "n_motifs", "cai", "bias", fused.alias("fused"), evidence.verdict(*(F.col(c) for c in ("n_hits", "n_motifs", "risk", "len"))).alias("verdict"), strength["ai"].alias("ai"), F.concat_ws(",", evidence.conflicts(strength, F.col("len"))).alias("conflicts"), text.alias("evidence"))


@query()
def screen(spark, sf_dir):
    """The screening table: one row per record with scores, verdict, strengths and evidence."""
    p = classified(spark, sf_dir).select("seq_id", T.risk(F.array("p0", "p1", "p2"), F.col("len")).alias("risk"))
    vectors, forest = envelope(spark, sf_dir)
    raw, cal = anchored(spark, sf_dir, vectors, forest)
    ood = raw.crossJoin(F.broadcast(cal)).select("seq_id", anomaly.calibrated(*(F.col(c) for c in ("raw", "mean", "std", "high", "direction"))).alias("ood"))
    return screened(spark, sf_dir, p, ood)


def screened_by(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The screening table by the models saved in a folder, with what was missing there and each record's anomaly flag."""
    found, seqs = models.load_models(spark, folder), sequences(spark, sf_dir)
    ood = staged(screening.anomalies(found, seqs), "anomalies")
    out = screened(spark, sf_dir, screening.risks(found, seqs).select("seq_id", "risk"), ood.select("seq_id", "ood"))
    return out.join(ood.select("seq_id", "flag"), "seq_id").withColumn("degraded", F.lit(",".join(found.degraded)))


@query()
def screen_saved(spark, sf_dir):
    """A run on models that were fitted on the labelled records, saved, and loaded again."""
    folder = shared_path(spark, "models")
    fitted = screening.fit_models(sequences(spark, sf_dir), labels(spark, sf_dir))
    models.save_models(spark, folder, fitted.classifier, fitted.envelope, fitted.calibration)
    return screened_by(spark, sf_dir, folder)


DEGRADED = "CASE WHEN n_hits > 0 OR n_motifs > 0 THEN 'CONFIRMED LAB-ENGINEERED' WHEN len > 0 AND len < 20 THEN 'BORDERLINE / REVIEW' ELSE 'LIKELY NATURAL' END"


@query(f"{SIGNALS} SELECT seq_id, len, n_hits, n_motifs, 0::DOUBLE AS risk, 0::DOUBLE AS ood, CASE WHEN n_hits > 0 OR n_motifs > 0 THEN 1 ELSE 0 END::DOUBLE AS fused, {DEGRADED} AS verdict, 'NOT_READY' AS flag, 'classifier,envelope,calibration' AS degraded FROM sig")
def screen_degraded(spark, sf_dir):
    """A run on a folder without models: hits and motifs decide alone."""
    out = screened_by(spark, sf_dir, shared_path(spark, "no-models"))
    return out.select("seq_id", "len", "n_hits", "n_motifs", "risk", "ood", "fused", "verdict", "flag", "degraded")


@query(f"{SIGNALS}, {LABELS} SELECT seq_id, CASE label WHEN 0 THEN 'NATURAL' WHEN 1 THEN 'VECTOR' WHEN 2 THEN 'SYNTHETIC' ELSE 'UNKNOWN' END AS true_label, CASE lang WHEN 'en' THEN 'EASY' WHEN 'de' THEN 'HARD' ELSE 'UNKNOWN' END AS difficulty, risk, ood, n_hits, round(round(0.60::DOUBLE * (risk / 100) + 0.2667::DOUBLE * least(n_hits / 10, 1), 9) + 1e-10, 4) AS fused, {VERDICT.format('', '')} AS verdict, len, gc_percent FROM sig JOIN seqs USING (seq_id) LEFT JOIN lab USING (seq_id)")
def benchmark_result(spark, sf_dir):
    """Verdicts beside the labels and levels that are parsed from the records' headers."""
    name = F.coalesce(F.when(F.col("label") == 0, "NATURAL"), F.when(F.col("label") == 1, "VECTOR"), F.when(F.col("label") == 2, "SYNTHETIC"), F.lit("OTHER"))
    level = F.when(F.col("lang") == "en", "EASY").when(F.col("lang") == "de", "HARD").otherwise("NONE")
    heads = sequences(spark, sf_dir).join(labels(spark, sf_dir), "seq_id", "left").select("seq_id", F.concat(F.lit("rec SRC="), name, F.lit(" "), level).alias("header"))
    known = ("NATURAL", "VECTOR", "SYNTHETIC")
    meta = heads.select("seq_id", T.header_label(F.col("header"), F.lit("rec"), known).alias("true_label"), T.header_level(F.col("header"), F.lit("rec")).alias("difficulty"))
    s = signals(spark, sf_dir).join(meta, "seq_id")
    return s.select("seq_id", "true_label", "difficulty", "risk", "ood", "n_hits", evidence.fused_benchmark(F.col("risk") / 100, F.col("n_hits")).alias("fused"), evidence.verdict(*(F.col(c) for c in ("n_hits", "n_motifs", "risk", "len"))).alias("verdict"), "len", "gc_percent")


# header variants, recalls by fold, tools, summary

HEADERS = "hd AS (SELECT doc_id AS seq_id, 'rec' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '_vector' ELSE '' END AS id, CASE WHEN doc_id % 3 = 0 THEN 'x SRC=LABEL_' || CASE label WHEN 0 THEN 'NATURAL' WHEN 1 THEN 'VECTOR' ELSE 'SYNTHETIC' END WHEN doc_id % 3 = 1 THEN 'some ' || CASE label WHEN 0 THEN 'natural' WHEN 1 THEN 'vector' ELSE 'Synthetic' END || ' text' ELSE 'no name' END AS header, CASE WHEN doc_id % 5 = 0 THEN 'VECTOR' END AS given FROM documents LEFT JOIN lab ON lab.seq_id = doc_id)"


def headers(spark, sf_dir):
    """Records' headers as such files have them: tagged, named or neither."""
    d = sequences(spark, sf_dir).select("seq_id").join(labels(spark, sf_dir), "seq_id", "left")
    name = F.when(F.col("label") == 0, "NATURAL").when(F.col("label") == 1, "VECTOR").otherwise("SYNTHETIC")
    word = F.when(F.col("label") == 0, "natural").when(F.col("label") == 1, "vector").otherwise("Synthetic")
    header = F.when(F.col("seq_id") % 3 == 0, F.concat(F.lit("x SRC=LABEL_"), name)).when(F.col("seq_id") % 3 == 1, F.concat(F.lit("some "), word, F.lit(" text"))).otherwise("no name")
    own = F.concat(F.lit("rec"), F.col("seq_id").cast("string"), F.when(F.col("seq_id") % 7 == 0, "_vector").otherwise(""))
    return d.select("seq_id", own.alias("id"), header.alias("header"), F.when(F.col("seq_id") % 5 == 0, "VECTOR").alias("given"))


@query(f"""WITH {LABELS}, {HEADERS}, t AS (SELECT seq_id, coalesce(given, nullif(regexp_extract(upper(header), 'SRC=LABEL_(NATURAL|VECTOR|SYNTHETIC)', 1), ''), CASE WHEN contains(upper(id), 'NATURAL') THEN 'NATURAL' WHEN contains(upper(id), 'VECTOR') THEN 'VECTOR' WHEN contains(upper(id), 'SYNTHETIC') THEN 'SYNTHETIC' END) AS tagged,
 CASE WHEN contains(upper(header), 'NATURAL') THEN 0 WHEN contains(upper(header), 'VECTOR') THEN 1 WHEN contains(upper(header), 'SYNTHETIC') THEN 1 END::BIGINT AS y FROM hd) SELECT * FROM t WHERE tagged IS NOT NULL OR y IS NOT NULL""")
def header_variants(spark, sf_dir):
    """Labels by the stricter parser and by the binary one; records that neither names drop out."""
    h = headers(spark, sf_dir)
    out = h.select("seq_id", T.tagged_label(F.col("header"), F.col("id"), F.col("given"), ("NATURAL", "VECTOR", "SYNTHETIC")).alias("tagged"), T.binary_label(F.col("header")).alias("y"))
    return out.filter("tagged IS NOT NULL OR y IS NOT NULL")


@query(f"{BASE}, pr AS (SELECT lang, label AS y, CASE WHEN ns >= 0.4 THEN 1 WHEN gc >= 0.12 THEN 2 ELSE 0 END AS p FROM scored JOIN seqs USING (seq_id)), e AS (SELECT lang, y, avg(CASE WHEN y = p THEN 1 ELSE 0 END) AS r FROM pr GROUP BY ALL) SELECT c AS class, count(r) AS folds, round(avg(r), 6) AS recall FROM (SELECT unnest([0, 1, 2])::BIGINT AS c) LEFT JOIN e ON y = c GROUP BY c")
def mean_recall(spark, sf_dir):
    """Recall of each class, averaged over the languages that have it."""
    s = scored(spark, sf_dir).join(sequences(spark, sf_dir).select("seq_id", "lang"), "seq_id")
    said = F.when(F.col("ns") >= 0.4, 1).when(F.col("gc") >= 0.12, 2).otherwise(0)
    return metrics.mean_recalls(s.select("lang", F.col("label").alias("y"), said.alias("p")), "lang", [0, 1, 2])


@query(f"""{BASE}, {BINARY}, {CUM}, {AUC}, {ROC}, a AS (SELECT score, sum(u) / (sum(pos) * sum(neg)) AS auroc FROM won GROUP BY score),
st AS (SELECT score, (tp / m - coalesce(lag(tp / m) OVER (PARTITION BY score ORDER BY x DESC), 0)) * tp / (tp + fp) AS s FROM roc), p AS (SELECT score, sum(s) AS ap FROM st GROUP BY score), {SWEEP.replace('unnest(' + str(THRESHOLDS) + ')', 'unnest([0.5])')}
SELECT tool, round(auroc, 6) AS auroc, round(ap, 6) AS auprc, round(f1, 6) AS f1 FROM (SELECT unnest(['gc', 'ns', 'absent']) AS tool) LEFT JOIN a ON a.score = tool LEFT JOIN p ON p.score = tool LEFT JOIN fs ON fs.score = tool""")
def tool_comparison(spark, sf_dir):
    """The two composition scores as tools, and one without predictions."""
    return metrics.tool_comparison(binary(spark, sf_dir).withColumnRenamed("score", "tool"), ["gc", "ns", "absent"])


@query(f"""{SIGNALS}, {LABELS}, lb AS (SELECT sig.*, lang = 'de' AS hard, n_hits = 0 AS unseen, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS y FROM sig JOIN lab USING (seq_id) JOIN seqs USING (seq_id)),
pts AS (SELECT 'classifier' AS score, y, hard, unseen, risk / 100 AS x FROM lb UNION ALL SELECT 'envelope', y, hard, unseen, ood / 100 FROM lb UNION ALL SELECT 'homology', y, hard, unseen, CASE WHEN n_hits > 0 THEN 1 ELSE 0 END::DOUBLE FROM lb),
{CUM}, {ROC}, cal AS (SELECT score, max(CASE WHEN fp / n <= 0.1::DOUBLE THEN tp / m ELSE 0 END) AS calibrated FROM roc GROUP BY score),
d AS (SELECT score, count(*) FILTER (y = 1) AS n, avg(CASE WHEN x >= 0.5::DOUBLE THEN 1 ELSE 0 END) FILTER (y = 1) AS rate, count(*) FILTER (y = 1 AND hard) AS n_hard, avg(CASE WHEN x >= 0.5::DOUBLE THEN 1 ELSE 0 END) FILTER (y = 1 AND hard) AS rate_hard,
 count(*) FILTER (y = 1 AND unseen) AS n_unseen, avg(CASE WHEN x >= 0.5::DOUBLE THEN 1 ELSE 0 END) FILTER (y = 1 AND unseen) AS rate_unseen FROM pts GROUP BY score)
SELECT tool, coalesce(n, 0) AS n, round(rate, 6) AS rate, coalesce(n_hard, 0) AS n_hard, round(rate_hard, 6) AS rate_hard, coalesce(n_unseen, 0) AS n_unseen, round(rate_unseen, 6) AS rate_unseen, round(calibrated, 6) AS calibrated
FROM (SELECT unnest(['classifier', 'envelope', 'homology', 'absent']) AS tool) LEFT JOIN d ON d.score = tool LEFT JOIN cal ON cal.score = tool""")
def detection_rates(spark, sf_dir):
    """What three engines find of all engineered records, of the hard ones (in German), and of those without a hit."""
    rows = signals(spark, sf_dir).join(labels(spark, sf_dir), "seq_id").join(sequences(spark, sf_dir).select("seq_id", "lang"), "seq_id")
    scores = {"classifier": F.col("risk") / 100, "envelope": F.col("ood") / 100, "homology": (F.col("n_hits") > 0).cast("double")}
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), x.alias("x")) for t, x in scores.items()))).alias("e")
    rows = rows.select((F.col("label") != 0).cast("int").alias("y"), (F.col("lang") == "de").alias("hard"), (F.col("n_hits") == 0).alias("unseen"), each)
    rows = staged(rows.select("e.*", "y", "hard", "unseen"), "detections")
    return metrics.detection_rates(rows, [*scores, "absent"], ["hard", "unseen"])


@query(f"""{BASE}, {BINARY}, {CUM}, {AUC}, {ROC}, a AS (SELECT score, sum(u) / (sum(pos) * sum(neg)) AS auroc FROM won GROUP BY score),
st AS (SELECT score, m, n, (tp / m - coalesce(lag(tp / m) OVER (PARTITION BY score ORDER BY x DESC), 0)) * tp / (tp + fp) AS s FROM roc), p AS (SELECT score, sum(s) AS ap, max(m) / (max(m) + max(n)) AS base FROM st GROUP BY score), {SWEEP}, b AS (SELECT *, row_number() OVER (PARTITION BY score ORDER BY f1 DESC, threshold) AS k FROM fs)
SELECT score, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(base, 6) AS base, threshold, round(precision, 6) AS precision, round(tpr, 6) AS recall, round(f1, 6) AS f1 FROM a JOIN p USING (score) JOIN b USING (score) WHERE k = 1""")
def evaluation_summary(spark, sf_dir):
    return metrics.evaluation_summary(binary(spark, sf_dir), THRESHOLDS, ("score",))


@query()
def ood_dual(spark, sf_dir):
    """Scores of two envelopes, of classes 0 and 1, on every record; the first decides."""
    vectors, forest = envelope(spark, sf_dir)
    other = anomaly.fit_forest(labelled_vectors(spark, sf_dir, vectors, 1))
    parts = []
    for own, f in enumerate((forest, other)):
        raw, cal = anchored(spark, sf_dir, vectors, f, own)
        parts.append(raw.crossJoin(F.broadcast(cal)).select("seq_id", anomaly.calibrated(*(F.col(c) for c in ("raw", "mean", "std", "high", "direction"))).alias("score")))
    return anomaly.dual_scores(*parts, sequences(spark, sf_dir).select("seq_id", F.length("seq").alias("len")))


@query()
def ood_track(spark, sf_dir):
    """The raw anomaly score along each record, by sliding windows."""
    natural = sequences(spark, sf_dir).join(labels(spark, sf_dir).filter("label = 0").select("seq_id"), "seq_id", "left_semi")
    forest = anomaly.fit_forest(staged(anomaly.vector_table(seq.whole_fragments(natural.select("seq_id", "seq"))), "natural-vectors"))
    windows = anomaly.window_vectors(sequences(spark, sf_dir).select("seq_id", "seq"))
    return anomaly.raw_scores(windows, forest).select("seq_id", "centre", "raw")


@query()
def ood_sanity(spark, sf_dir):
    vectors, forest = envelope(spark, sf_dir)
    # only the first records of classes 0 and 2 are asked for
    first = folds.first_per_group(labels(spark, sf_dir).join(vectors.select("seq_id").distinct(), "seq_id").filter("label IN (0, 2)"), "label", ["seq_id"], 20)
    return anomaly.sanity(anomaly.record_scores(anomaly.raw_scores(vectors.join(F.broadcast(first.select("seq_id")), "seq_id", "left_semi"), forest)).join(labels(spark, sf_dir), "seq_id"))


@query()
def saliency(spark, sf_dir):
    """Importance of the 8-mer at each position of each record, those across the borders of fragments too."""
    importances = classify.token_importances(staged(training(spark, sf_dir).select("label", "frag"), "training"))
    return features.saliency_track(sequences(spark, sf_dir), importances)
