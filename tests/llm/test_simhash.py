import numpy as np
import pytest
import xxhash

from strandsieve.llm import components, simhash

from .fixtures import documents, texts


def plain(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("block", [4096, 10])
def test_equals_brute_force(spark, block):
    got = simhash.simhash_components(documents(spark), block=block).collect()
    rows = [(i, plain(t, 4)) for i, t in texts()]
    root = list(range(len(rows)))
    while True:
        new = [min([root[j] for j in range(len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 4]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    least = {r: min([rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None], default=None) for r in root}
    want = sorted((str(i), f, str(least[root[k]])) for k, (i, f) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want


def test_golay_keys_meet():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 23, 4000)
    for n in (0, 1, 2):
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(23, n, replace=False):
                b[i] ^= 1 << int(bit)
        x, y = simhash.segment_keys(a), simhash.segment_keys(b)
        assert all({k for k in p if k >= 0} & {k for k in q if k >= 0} for p, q in zip(x.tolist(), y.tolist(), strict=True))
    assert set((simhash.segment_keys(a) >= 0).sum(axis=1).tolist()) <= {1, 6}


def test_tree_connects_what_links_connect():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 2).astype(np.uint64)
    fp = np.array([[base[0] ^ np.uint64(1 << int(rng.integers(60))), base[1] ^ np.uint64(1 << int(rng.integers(60)))] for _ in range(50)])
    a, b = simhash._tree(fp, 8)
    assert len(a) == 49 and len({*a, *b}) == 50


@pytest.mark.parametrize("block", [4096, 9])
def test_similar_documents_leave_one(spark, block):
    rows = [(i, t) for i, t in texts() if i is not None]
    docs = documents(spark, rows)
    links = simhash.similar_links(docs.selectExpr("doc_id AS doc", "text"), block=block).collect()
    sets = {i: {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    for r in links:
        u, v = sets[r.x], sets[r.y]
        assert len(u & v) >= 0.8 * len(u | v)
    kept = {r.doc_id for r in simhash.keep_near(docs).collect()}
    assert kept >= set(range(2, 40)) - {5} | {100, 101, 102, 300} and not kept & set(range(301, 312)) and not kept & set(range(111, 135))


@pytest.mark.parametrize("block", [4096, 40])
def test_failed_tree_edges_displace_no_links(spark, block):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(240, int(rng.integers(3, 7)), replace=False):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    prints = np.array([[simhash.simhash(h), simhash.simhash(simhash._other(h))] for h in sets], np.uint64)
    keys = [set() for _ in rows]
    for k in range(2):
        for r, key in zip(*simhash.bucket_keys(np.ascontiguousarray(prints[:, k])), strict=True):
            keys[r].add((k, int(key)))

    alike = lambda i, j: (both := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
    links = simhash.similar_links(documents(spark, rows).selectExpr("doc_id AS doc", "text"), block=block).collect()
    assert all(alike(r.x, r.y) for r in links)
    root = list(range(len(rows)))
    for r in links:
        root = [root[r.x] if k == root[r.y] else k for k in root]
    assert len(set(root)) > 1
    held = [(i, j) for i in range(len(rows)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= 27 and keys[i] & keys[j] and alike(i, j)]
    assert held and all(root[i] == root[j] for i, j in held)


def test_common_elements():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 500, int(rng.integers(0, 300)), dtype=np.uint64)) for _ in range(30)]
    got = simhash._common(sets, 64)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    got = components.connected_components(edges.unionAll(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a long, b long"))).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


def test_empty_table(spark):
    assert simhash.simhash_components(documents(spark, [])).count() == 0
    assert simhash.keep_near(documents(spark, [])).count() == 0
