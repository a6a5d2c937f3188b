import hashlib
import math

from strandsieve.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string, distance int"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, e, 1, "x", "y", 2) for i, e in rows], schema).repartition(3)


def plain(rows, k, rounds, seed=2, components=64):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in (first + sorted((r for r in kept if r[0] is None), key=lambda r: r[1]))[:k]]
    apart = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [(i, near(v)) for i, v in kept]
    inertia = {}
    for _, (d, j) in found:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, (d, j) in found), key=str)


def ours(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def odd_rows():
    rng = __import__("random").Random(3)
    rows = [(i, [round(rng.gauss(i % 5, 0.3), 3) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5), (204, [1.0, None, 1.0, 1.0]), (205, [1.0, float("nan"), 1.0, 1.0]), (206, [float("-inf"), 1.0, 1.0, 1.0])]
    rows += [(300, [0.0, -0.0, -0.001, 0.001])] * 3 + [(None, [2.0] * 4), (None, [-2.0] * 4), (5, [9.0] * 4)]
    rows += [(400 + i, [3.0] * 4) for i in range(60)]  # a third are equal
    return rows


def test_equals_plain_rounds(spark):
    rows = odd_rows()
    for k, rounds in ((7, 5), (1, 2), (3, 0)):
        assert ours(clusters.centroid_clusters(table(spark, rows), k, rounds, components=4)) == plain(rows, k, rounds, components=4)


def test_fewer_vectors_than_centroids_and_ties(spark):
    rows = [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 3.0]), (4, [1.0, 2.0])]
    got = ours(clusters.centroid_clusters(table(spark, rows), 40, 3, components=2))
    assert got == plain(rows, 40, 3, components=2) and len(got) == 4


def test_without_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = clusters.centroid_clusters(table(spark, rows))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not got.collect()


def test_large_components_are_held(spark):
    rows = [(1, [1e300, -1e300]), (2, [0.0, 0.0]), (3, [1e6, 1e6])]
    got = {r.vec_id: r for r in clusters.centroid_clusters(table(spark, rows), 1, 1, components=2).collect()}
    top = clusters.LIMIT
    middle = ((top + 0 + top) // 3, (-top + 0 + top) // 3)
    assert got[1].distance == (top - middle[0]) ** 2 + (-top - middle[1]) ** 2
    assert got[2].inertia == sum(r.distance for r in got.values())


def test_floats_count_as_doubles(spark):
    rows = [(i, [i / 7, -i / 3]) for i in range(20)]
    floats = table(spark, rows, SCHEMA.replace("double", "float"))
    exact = [(r.vec_id, list(r.embedding)) for r in floats.collect()]
    assert ours(clusters.centroid_clusters(floats, 3, 2, components=2)) == plain(exact, 3, 2, components=2)
