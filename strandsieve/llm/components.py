"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node reachable.

    Nodes are longs. Each round is two joins and two aggregations on the edges and is written to the shared folder, the
    nodes' minima before they are joined: so both sides of a join come straight from a shuffle, and Spark can split the
    rows of a hub with many edges. Nothing is gathered on the driver but whether the round changed an edge. Rows with
    nulls and loops count for nothing; no edge gives no row.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
        large = staged(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        then = staged(small.filter("u <> v").distinct(), "edges")
        # stars alone change no more: every left end has one edge and no right end is a left end
        if then.groupBy("u").count().filter("count > 1").isEmpty() and then.join(then.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return then.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(then.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = then
