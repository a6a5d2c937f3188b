"""Centroid clustering of whole-number vectors in JVM expressions.

The centroids are one literal of the plan: zip_with and aggregate give a vector's squared distance to each, array_min of
structs (distance, cluster) chooses the nearest and among equals the smaller number, and one sum a component, combined
in each task before anything travels, moves the centroids. A round reads the vectors once and brings k rows to the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Components are held within this, so that squared distances and sums of columns stay within a long.
LIMIT = 1 << 27


def whole_vectors(vectors: DataFrame, components: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v) of the vectors with so many components, none null or non-finite: v has floor(scale * x) as longs."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))) & ~F.isnan(c.cast("double")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LIMIT).cast("long")), F.lit(-LIMIT).cast("long")))
    return vectors.filter(F.coalesce((F.size(x) == components) & finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def nearest(centroids: list[tuple[int, ...]]) -> Column:
    """The struct (distance, cluster) of the centroid c that is nearest to v: distances are compared without v * v, which all share."""
    known = ", ".join(f"struct(array({', '.join(f'{x}L' for x in c)}) AS c, {sum(x * x for x in c)}L AS square)" for c in centroids)
    product = "aggregate(zip_with(v, {}, (x, y) -> x * y), 0L, (s, p) -> s + p)"
    least = f"array_min(transform(array({known}), (k, i) -> struct(k.square - 2 * {product.format('k.c')} AS distance, i AS cluster)))"
    return F.transform(F.array(F.expr(least)), lambda m: F.struct((m["distance"] + F.expr(product.format("v"))).alias("distance"), m["cluster"].alias("cluster")))[0]


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, components: int = 64, scale: int = 256) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors has vec_id and embedding. Kept are vectors of so many components, none null, NaN or infinite; other rows give
    none. Components count as floor(scale * x), held within 2^27 either way. The k kept vectors with the smallest SHA-256 of
    "seed:vec_id" are the first centroids (fewer vectors: all of them; rows of one vec_id by their components, a null vec_id
    last). In each round every vector goes to its nearest centroid, of equally near ones to that with the smaller number, and each
    centroid that has vectors moves to the floor of their mean; at last vectors are assigned once more. Repeated rows count
    each. Inertias that no long holds are null. Other columns count for nothing, whatever their names. An empty table, or one
    without kept vectors, gives an empty result.
    """
    spark = vectors.sparkSession
    # a vector costs thousands of operations a round, so few bytes make a task
    kept = whole_vectors(vectors, components, scale).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept = staged(kept, "whole-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [tuple(r.v) for r in kept.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()]
    if not centroids:
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(components)]
        for r in kept.select("v", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
            centroids[r.cluster] = tuple(r[f"s{i}"] // r.n for i in range(components))
    found = staged(kept.select("vec_id", nearest(centroids).alias("found")).select("vec_id", "found.cluster", "found.distance"), "assigned")
    inertia = {r.cluster: r for r in found.rollup("cluster").agg(F.expr("try_sum(distance)").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster = F.array(*(F.lit(inertia[i].inertia if i in inertia else None).cast("long") for i in range(len(centroids))))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.get(of_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(inertia[None].inertia).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )
