"""Running sums and ranks over any number of rows: rows are dealt out by ranges of their order, summed in each range, and
what the earlier ranges hold is added. No task orders a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Ranges of a key's scores, and of its hashes.
RANGES, HASHES = 128, 1024


def mixed(col: str | Column, seed: int = 42) -> Column:
    """An arithmetic hash below 1,000,003 that any SQL engine can repeat; ids order equal hashes."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.pmod(c, F.lit(1_000_003)) * 2654435761 + seed, F.lit(1_000_003))


def score_range(df: DataFrame, by: tuple[str, ...], x: str) -> DataFrame:
    """Adds _range: the number of x's range among those of its key, cut at approximate quantiles of x."""
    cuts = F.percentile_approx(x, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(1000)).alias("_cuts")
    bounds = df.groupBy(*by).agg(cuts)
    marked = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    return marked.withColumn("_range", F.size(F.filter("_cuts", lambda v: v < F.col(x)))).drop("_cuts")


def running_sums(df: DataFrame, by: tuple[str, ...], x: str, cols: tuple[str, ...]) -> DataFrame:
    """Adds below_c, the sum of c over the rows of the key with a smaller x, and all_c, the key's sum, for each c of cols.

    x is distinct within a key. If df has _range already, it says how rows are dealt out.
    """
    marked = df if "_range" in df.columns else score_range(df, by, x)
    key = Window.partitionBy(*by) if by else Window.partitionBy()
    sums = marked.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_s_{c}") for c in cols))
    earlier = key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each key and range
    sums = sums.select(*by, "_range", *(F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in cols), *(F.sum(f"_s_{c}").over(key).alias(f"all_{c}") for c in cols))
    inside = Window.partitionBy(*by, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in cols}).join(sums, [*by, "_range"])
    return out.withColumns({f"below_{c}": F.col(f"_o_{c}") + F.col(f"_i_{c}") for c in cols}).drop("_range", *(f"_{k}_{c}" for c in cols for k in "oi"))


def quantiles(df: DataFrame, by: tuple[str, ...], x: str, shares: list[float]) -> DataFrame:
    """by and q, the exact quantiles of x at these shares, between two values in proportion: null ones don't count, and a key
    without others has no row.

    Values are counted and ranked in ranges of their order, so no task holds a key's values.
    """
    counted = df.filter(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(staged(counted, "counted-values"), by, "_x", ("_c",))
    ends, out = [], []
    for i, share in enumerate(shares):
        at = (F.col("all__c") - 1) * share
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends.append(F.max(F.when((F.col("below__c") <= place) & (place < F.col("below__c") + F.col("_c")), F.col("_x"))).alias(f"_{name}{i}"))
        at = (F.col("_n") - 1) * share
        between = (F.ceil(at) - at) * F.col(f"_lo{i}") + (at - F.floor(at)) * F.col(f"_hi{i}")
        out.append(F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(between))
    return ranked.groupBy(*by).agg(F.max("all__c").alias("_n"), *ends).filter("_n > 0").select(*by, F.array(*out).alias("q"))


def hash_rank(df: DataFrame, by: tuple[str, ...], key: str, seed: int = 42, first: str | None = None, name: str = "_rank") -> DataFrame:
    """Adds the 1-based rank of a row within by, in the order of first (descending, if given), of the key's hash, and of the key."""
    order = [first] if first else []
    hashed = df.withColumn("_h", mixed(key, seed)).withColumn("_part", F.floor(F.col("_h") * HASHES / 1_000_003))
    sizes = hashed.groupBy(*by, *order, "_part").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order), "_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, *order, "_part", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, *order, "_part").orderBy("_h", key))
    ranked = hashed.withColumn("_in", inside).join(sizes, [*by, *order, "_part"])
    return ranked.withColumn(name, F.col("_before") + F.col("_in")).drop("_h", "_part", "_before", "_in")
