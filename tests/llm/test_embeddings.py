import numpy as np

from strandsieve.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string, v string, kept int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], y, "x", "y", 1, 2) for i, e, y in rows], SCHEMA).repartition(3)


def plain(rows, cosine=0.93):
    good = [e is not None and y is not None and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e) for _, e, y in rows]
    unit = [np.array(e, float) / np.abs(e).max() / np.linalg.norm(np.array(e, float) / np.abs(e).max()) if g else None for (_, e, _), g in zip(rows, good, strict=True)]
    links = [[k for k in range(len(rows)) if k != j and good[j] and good[k] and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for j in range(len(rows))]
    out, seen = {}, set()
    for j in range(len(rows)):
        if j in seen:
            continue
        todo, own = [j], {j}
        while todo:
            for k in links[todo.pop()]:
                if k not in own:
                    own.add(k)
                    todo.append(k)
        seen |= own
        low = min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
        out |= {k: (rows[k][0], len(links[k]), low, rows[k][0] == low) for k in own}
    return sorted(out.values(), key=str)


def ours(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def clustered(rng, n, spread, dims=24, centres=12):
    c = rng.standard_normal((centres, dims))
    return c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dims))


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(clustered(rng, 300, 0.12))]
    rows += [(400 + i, rows[7][1], 1) for i in range(150)]  # a third are equal
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 24, 1), (603, [1.0, None], 1), (604, [float("nan")] * 24, 1), (605, [float("inf"), 1.0], 1), (606, rows[7][1], None)]
    rows += [(607, [1.0, 2.0], 1), (608, [10.0, 20.0], 1), (609, [1e-300, 2e-300], 1), (610, [1e300, 2e300], 1), (611, [-1.0, -2.0], 1), (612, [0.0, 1.0], 1)]
    rows += [(None, [3.0, 1.0, 1.0], 2), (None, [3.0, 1.0, 1.0], 2), (None, [6.0, 2.0, 2.0], 5), (5, [6.0, 2.0, 2.0], 5), (9, [1.0, 5.0, 0.0], 7), (9, [1.0, 5.0, 0.0], 7), (9, [5.0, 0.0, 1.0], 7)]
    return rows


def test_equals_all_pairs(spark):
    rows = odd_rows()
    want = plain(rows)
    assert sum(n for _, n, _, _ in want) > 1000
    assert ours(embeddings.near_vectors(table(spark, rows))) == want
    assert ours(embeddings.near_vectors(table(spark, rows), block=3)) == want  # nearly all buckets in blocks


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        c = 0.9301
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 0)]
    found = embeddings.near_vectors(table(spark, rows)).filter("n_links > 0").count()
    assert 0.995 * 3000 <= found <= 3000  # 99.96 % by calculation


def test_none_below_the_threshold(spark):
    c = 0.9299999
    rows = [(1, [1.0, 0.0], 0), (2, [c, float(np.sqrt(1 - c * c))], 0), (3, [1.0, 0.0], 1)]
    assert [r[1] for r in ours(embeddings.near_vectors(table(spark, rows)))] == [0, 0, 0]


def test_empty_table(spark):
    got = embeddings.near_vectors(table(spark, []))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and not got.collect()


def test_compare_bucket_counts_a_pair_in_its_first_table_alone():
    rng = np.random.default_rng(1)
    x = embeddings.unit(clustered(rng, 200, 0.1))
    codes = rng.integers(0, 3, (200, 4)).astype(np.int32)
    n = rng.integers(1, 5, 200)
    links, edges = np.zeros(200, np.int64), set()
    for t in range(4):
        for c in range(3):
            at = np.flatnonzero(codes[:, t] == c)
            found, own = embeddings.compare_bucket(x[at], codes[at], n[at], None, t, 0.93, stripe=16)
            links[at] += found
            edges |= {(int(at[a]), int(at[b])) for a, b in own}
    near = (x @ x.T >= 0.93) & (codes[:, None] == codes).any(axis=2)
    np.fill_diagonal(near, False)
    assert (links == near @ n).all()

    def reach(pairs):
        top = list(range(200))
        for _ in range(200):
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    assert reach(sorted(edges)) == reach([tuple(map(int, p)) for p in np.argwhere(near)])
