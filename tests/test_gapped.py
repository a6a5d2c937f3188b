import random

from pyspark.sql import functions as F

from strandsieve.operators import gapped, motif, seq

LETTERS = "ATGC"
LOW = -(10**9)


def mutated(x, rng, rate=0.03, most=5):
    out = []
    for c in x:
        r = rng.random()
        if r < rate:
            out.append(rng.choice(LETTERS))
        elif r < 1.5 * rate:
            continue
        elif r < 2 * rate:
            out += [c, *rng.choices(LETTERS, k=rng.randint(1, most))]
        else:
            out.append(c)
    return "".join(out)


def full_program(q, s, local):
    """(score, end in q, end in s) of the best alignment, anywhere or from the beginning of both."""
    n, m = len(q), len(s)
    h, e, f = ([[LOW] * (m + 1) for _ in range(n + 1)] for _ in range(3))
    best = (0, 0, 0)
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                f[i][j] = max(h[i - 1][j] - 4, f[i - 1][j] - 2)
            if j:
                e[i][j] = max(h[i][j - 1] - 4, e[i][j - 1] - 2)
            d = h[i - 1][j - 1] + (1 if q[i - 1] == s[j - 1] else -2) if i and j else LOW
            h[i][j] = max(d, e[i][j], f[i][j], 0 if local or not i and not j else LOW)
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    return best


def text(rng, n):
    return "".join(rng.choices(LETTERS, k=n))


def test_extension_is_the_full_program():
    rng = random.Random(2)
    pairs = [(x := text(rng, rng.randint(0, 100)), mutated(x, rng) + text(rng, rng.randint(0, 20))) for _ in range(120)]
    pairs = [(a, b) if k % 2 else (b, a) for k, (a, b) in enumerate(pairs)]
    found = gapped.extend([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], drop=10**6)
    for (a, b), (score, n, m, equal, different, gaps, letters, _) in zip(pairs, found, strict=True):
        assert score == full_program(a, b, False)[0] == equal - 2 * different - 2 * gaps - 2 * letters
        assert n + m == 2 * (equal + different) + letters


def reverse(x):
    return x[::-1].translate(str.maketrans("ATGC", "TACG"))


def planted(rng):
    """Queries with mutated pieces of references, on both strands, and without any."""
    refs = [(100 + k, text(rng, rng.randint(80, 260))) for k in range(8)]
    refs += [(200, refs[0][1]), (201, "A" * 120), (202, "AT" * 60), (203, ""), (204, None), (None, text(rng, 90))]
    queries = []
    for k in range(40):
        ref = refs[k % 8][1]
        piece = mutated(ref[rng.randint(0, 15) :], rng)
        piece = reverse(piece) if k % 3 == 0 else piece
        queries.append((k, text(rng, rng.randint(0, 200)) + (piece if k % 5 else "") + text(rng, rng.randint(0, 200))))
    return queries + [(50, "A" * 300), (51, "N" * 300), (52, ""), (53, None), (None, queries[1][1]), (1, queries[2][1])], refs


def tables(spark, queries, refs):
    return spark.createDataFrame([(*q, "x") for q in queries], "seq_id long, seq string, ref_id string"), spark.createDataFrame([(*r, 1) for r in refs], "ref_id long, seq string, score int")


def test_best_hits_are_those_of_full_programs(spark):
    rng = random.Random(7)
    queries, refs = planted(rng)
    q, r = tables(spark, queries, refs)
    hits = gapped.gapped_hits(q, r).collect()
    score = lambda h: h.alignment_length - h.mismatches - gap_letters(h) - 2 * h.mismatches - 2 * h.gap_opens - 2 * gap_letters(h)
    known = {i: s for i, s in refs if i is not None and s}
    size = sum(map(len, known.values()))
    found = {}
    for h in hits:
        s = known[h.subject_id]
        n, m = h.q_end - h.q_start + 1, abs(h.s_end - h.s_start) + 1
        assert 1 <= h.q_start <= h.q_end and 1 <= min(h.s_start, h.s_end) and max(h.s_start, h.s_end) <= len(s)
        assert n + m == 2 * h.alignment_length - gap_letters(h) and h.evalue <= 1e-5
        found[h.query_id, h.subject_id] = max(found.get((h.query_id, h.subject_id), 0), score(h))
    total = 0
    for i, text_ in queries[:40]:
        if i == 1:
            continue  # two rows
        for j, s in known.items():
            best = max(full_program(text_, s, True)[0], full_program(text_, reverse(s), True)[0])
            if best >= 50:
                assert found.get((i, j)) == best, (i, j, best)
                total += 1
            else:
                assert found.get((i, j), 0) <= best
    assert total >= 25 and any(h.gap_opens for h in hits) and any(h.s_start > h.s_end for h in hits)
    # low complexity starts nothing; a row without an id is a query like others; equal references have equal hits
    assert not {50, 51, 52, 53} & {h.query_id for h in hits} and not {201, 202, 203, 204, None} & {h.subject_id for h in hits}
    assert {h.query_id for h in hits} >= {None, 1}
    of = lambda ref: sorted(str(h[:1] + h[2:]) for h in hits if h.subject_id == ref)
    assert of(100) == of(200) != [] and size
    # how much is cut at first changes nothing
    short = gapped.gapped_hits(q, r, reach=20).collect()
    assert sorted(map(str, short)) == sorted(map(str, hits))


def gap_letters(h):
    return 2 * h.alignment_length - (h.q_end - h.q_start + 1) - (abs(h.s_end - h.s_start) + 1)


def test_extensions_run_through_masked_letters(spark):
    rng = random.Random(3)
    a, b = text(rng, 60), text(rng, 60)
    q, r = tables(spark, [(1, a + "A" * 30 + b)], [(1, a + "A" * 30 + b)])
    best = max(gapped.gapped_hits(q, r).collect(), key=lambda h: h.bit_score)
    assert (best.q_start, best.q_end, best.percent_identity) == (1, 150, 100.0)
    got = [tuple(x) for x in gapped.masked_regions(q).select("seq_id", "start", "end").collect()]
    assert len(got) == 1 and 50 < got[0][1] <= 60 and 90 <= got[0][2] < 100


def test_seeds_of_repeats_are_no_rows(spark):
    q, r = tables(spark, [(1, "AT" * 5000 + "A" * 5000 + "N" * 5000)], [(1, "TA" * 3000), (2, "A" * 3000), (3, "N" * 3000)])
    strands = r.select("ref_id", F.lit("+").alias("strand"), "seq")
    assert gapped.anchors(q, strands, 11, 40, 16).count() == 0


def test_empty_tables(spark):
    for queries, refs in (([], [(1, "ATGC" * 30)]), ([(1, "ATGC" * 30)], []), ([], [])):
        got = gapped.gapped_hits(*tables(spark, queries, refs))
        assert got.columns[:3] == ["query_id", "subject_id", "percent_identity"] and not got.collect()


def test_many_motifs_on_both_strands(spark):
    rng = random.Random(11)
    motifs = {f"m{i}": text(rng, rng.randint(5, 9)) for i in range(10_000)} | {"palindrome": "GAATTC", "same": "GAATTC", "none": ""}
    seqs = [(1, text(rng, 3000)), (2, "GAATTCGAATTC"), (3, ""), (4, None), (5, "GAATT"), (5, "AAGAATTC")]
    got = sorted(map(tuple, motif.motif_strands(spark.createDataFrame(seqs, "seq_id long, seq string"), motifs).collect()))
    want = []
    for i, t in seqs:
        for name, p in motifs.items():
            for strand, x in (("+", p), ("-", reverse(p))):
                at = (t or "").find(x) if x else -1
                while at >= 0:
                    want.append((i, name, strand, at + 1, at + len(x)))
                    at = t.find(x, at + 1)
    assert got == sorted(want) and len(got) > 1000
    assert motif.motif_strands(spark.createDataFrame(seqs, "seq_id long, seq string"), {}).count() == 0


def test_one_long_record_takes_time_by_its_length(spark):
    import time

    took = {}
    for n in (250_000, 250_000, 2_000_000):  # the first run compiles
        df = spark.range(1).selectExpr("id AS seq_id", f"repeat('ATGCCGTANNATCGGA', {n // 16}) AS seq")
        began = time.time()
        assert seq.kmer_counts(df, 4).agg(F.sum("cnt")).first()[0] == n - 3
        took[n] = time.time() - began
    assert took[2_000_000] < 30 * took[250_000] + 2  # in proportion 8, by the square 64
