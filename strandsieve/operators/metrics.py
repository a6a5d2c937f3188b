"""Ranks, curves, intervals and tables of labelled scores, by key.

A table of labelled scores is (key..., y, x): y is 1 or 0 (or a class), x the score. Rows are first counted by distinct
score; sums along the scores run in ranges of them (ranges.py), so no task orders all scores of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import quantiles, running_sums

#: The two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def by_score(df: DataFrame, by: tuple[str, ...], y: str = "y", x: str = "x") -> DataFrame:
    """by, x, pos and neg: counts at each distinct score."""
    return df.groupBy(*by, x).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))


def midranks(df: DataFrame, by: tuple[str, ...], x: str = "x") -> DataFrame:
    """Adds midrank: the mean of the 1-based ranks that equal scores of a key share."""
    counted = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_sums(counted, by, x, ("_c",)).select(*by, x, (F.col("below__c") + (F.col("_c") + 1) / 2).alias("midrank"))
    return df.join(ranks, [*by, x])


def auroc(df: DataFrame, by: tuple[str, ...], y: str = "y", x: str = "x") -> DataFrame:
    """by, m (positives), n (negatives) and auroc, equal scores counting half; null without both kinds."""
    won = running_sums(by_score(df, by, y, x), by, x, ("neg",)).withColumn("_won", F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    out = won.groupBy(*by).agg(F.sum("pos").alias("m"), F.sum("neg").alias("n"), F.sum("_won").alias("_u"))
    return out.select(*by, "m", "n", (F.col("_u") / F.nullif(F.col("m") * F.col("n"), F.lit(0))).alias("auroc"))


def one_vs_rest(df: DataFrame, classes: list[int], scores: dict[int, str], label: str = "label") -> DataFrame:
    """(class, y, x): each row once for each class."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (F.col(label) == c).cast("int").alias("y"), F.col(scores[c]).alias("x")) for c in classes))).alias("o")
    return df.select(parts).select("o.class", "o.y", "o.x")


def macro_auroc(df: DataFrame, classes: list[int], scores: dict[int, str], label: str = "label") -> DataFrame:
    """One row: the mean of the one-versus-rest AUROCs; null if a class has no row."""
    each = auroc(one_vs_rest(df, classes, scores, label), ("class",))
    return each.agg(F.when((F.count("auroc") == len(classes)), F.avg("auroc")).alias("macro_auroc"))


def roc_points(df: DataFrame, by: tuple[str, ...], y: str = "y", x: str = "x") -> DataFrame:
    """by, x, tp, fp, tpr, fpr at each distinct score taken as the threshold."""
    return _points(by_score(df, by, y, x), by, x).select(*by, x, "tp", "fp", "tpr", "fpr")


def _points(counted: DataFrame, by: tuple[str, ...], x: str) -> DataFrame:
    out = running_sums(counted, by, x, ("pos", "neg")).withColumns({"tp": F.col("all_pos") - F.col("below_pos"), "fp": F.col("all_neg") - F.col("below_neg")})
    return out.withColumns({"tpr": F.col("tp") / F.nullif("all_pos", F.lit(0)), "fpr": F.col("fp") / F.nullif("all_neg", F.lit(0))})


def average_precision(df: DataFrame, by: tuple[str, ...], y: str = "y", x: str = "x") -> DataFrame:
    """by, ap (steps of recall times precision) and base (share of positives); null without positives."""
    return counted_precision(by_score(df, by, y, x), by, x)


def counted_precision(counted: DataFrame, by: tuple[str, ...], x: str = "x") -> DataFrame:
    """average_precision from pos and neg at each distinct score."""
    step = F.col("pos") / F.nullif("all_pos", F.lit(0)) * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    return _points(counted, by, x).groupBy(*by).agg(F.sum(step).alias("ap"), (F.max("all_pos") / F.nullif(F.max("all_pos") + F.max("all_neg"), F.lit(0))).alias("base"))


def delong(df: DataFrame, by: tuple[str, ...], y: str = "y", x: str = "x", z: float = Z95) -> DataFrame:
    """by, auroc, variance, lo, hi: DeLong's interval, cut to [0, 1]; a kind with one row adds no variance."""
    p = running_sums(by_score(df, by, y, x), by, x, ("pos", "neg")).withColumnsRenamed({"all_pos": "_m", "all_neg": "_n"})
    p = p.withColumns({"v": (F.col("below_neg") + F.col("neg") / 2) / F.nullif("_n", F.lit(0)), "u": 1 - (F.col("below_pos") + F.col("pos") / 2) / F.nullif("_m", F.lit(0))})

    def var(weight: str, value: str) -> Column:
        n, s, q = F.sum(weight), F.sum(F.col(weight) * F.col(value)), F.sum(F.col(weight) * F.col(value) * F.col(value))
        return F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)) / n).otherwise(0.0)

    out = p.groupBy(*by).agg(F.first("_m").alias("m"), F.first("_n").alias("n"), (F.sum(F.col("pos") * F.col("v")) / F.nullif(F.first("_m"), F.lit(0))).alias("auroc"), (var("pos", "v") + var("neg", "u")).alias("variance"))
    half = F.sqrt("variance") * z
    return out.select(*by, "m", "n", "auroc", "variance", F.greatest(F.col("auroc") - half, F.lit(0.0)).alias("lo"), F.least(F.col("auroc") + half, F.lit(1.0)).alias("hi"))


def ecdf_risk(train: DataFrame, test: DataFrame, x: str = "x") -> DataFrame:
    """Adds risk to test: the share of train scores below its score, equal ones counting half, from the counts of both
    tables' distinct scores."""
    both = train.groupBy(x).agg(F.count(F.lit(1)).alias("c")).unionAll(test.select(x).distinct().select(x, F.lit(0).alias("c")))
    both = both.groupBy(x).agg(F.sum("c").alias("c"))
    both = running_sums(both, (), x, ("c",))
    up_to = F.col("below_c") + F.col("c")
    ranks = both.select(x, ((F.col("below_c") + up_to + F.when(up_to > F.col("below_c"), 1).otherwise(0)) / (2 * F.col("all_c"))).alias("risk"))
    return test.join(ranks, x)


def confusion(df: DataFrame, classes: list[int], y: str = "y", p: str = "p") -> DataFrame:
    """y, p, n and share (of the row) for each pair of classes, zeros included."""
    spark = df.sparkSession
    one = spark.createDataFrame([(c,) for c in classes], "y int")
    grid = one.crossJoin(one.withColumnRenamed("y", "p"))
    counted = df.groupBy(F.col(y).cast("int").alias("y"), F.col(p).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    full = F.broadcast(grid).join(counted, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))
    row = F.greatest(F.sum("n").over(Window.partitionBy("y")), F.lit(1))
    return full.withColumn("share", F.col("n") / row)


def class_report(df: DataFrame, classes: list[int], y: str = "y", p: str = "p") -> DataFrame:
    """class, precision, recall, f1 and support by class and MACRO; a zero denominator gives 0."""
    cells = confusion(df, classes, y, p)
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, said, is_ = (cells.filter("y = p").select(F.col("y").alias("c"), F.col("n").alias("tp")), cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("said")), cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support")))
    each = reduce(lambda a, b: a.join(b, "c"), (tp, said, is_))
    each = each.select(F.col("c").cast("string").alias("class"), zero(F.col("tp"), F.col("said")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")
    macro = each.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    return each.unionByName(macro.select(F.lit("MACRO").alias("class"), "*"))


def accuracy_check(df: DataFrame, classes: list[int], y: str = "y", p: str = "p") -> DataFrame:
    """One row: accuracy, mean recall, whether classes are balanced, and the verdict ok, fail or warn."""
    cells = confusion(df, classes, y, p)
    rows = cells.groupBy("y").agg(F.sum("n").alias("s"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    one = rows.agg((F.sum("tp") / F.nullif(F.sum("s"), F.lit(0))).alias("accuracy"), F.avg(F.col("tp") / F.greatest("s", F.lit(1))).alias("mean_recall"), (F.min("s") == F.max("s")).alias("balanced"))
    ok = F.abs(F.col("mean_recall") - F.col("accuracy")) < 0.01
    return one.withColumn("verdict", F.when(~F.col("balanced"), "warn").when(ok, "ok").otherwise("fail"))


def at_threshold(df: DataFrame, by: tuple[str, ...], threshold: Column, y: str = "y", x: str = "x") -> DataFrame:
    """by, tp, fp, fn, tn, tpr, fpr, precision, f1 for scores of at least threshold."""
    hit = (F.col(x) >= threshold).cast("int")
    count = lambda a, b: F.coalesce(F.sum(F.when((F.col(y) == a) & (hit == b), 1).otherwise(0)), F.lit(0))
    c = df.groupBy(*by).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    over = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    c = c.withColumns({"tpr": over("tp", "fn"), "fpr": over("fp", "tn"), "precision": over("tp", "fp")})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("tpr") / F.greatest(F.col("precision") + F.col("tpr"), F.lit(1e-9)))


def threshold_sweep(df: DataFrame, thresholds: list[float], by: tuple[str, ...] = (), y: str = "y", x: str = "x") -> DataFrame:
    """at_threshold for each of a few thresholds, from the counts by distinct score."""
    spread = df.select(*by, y, x, F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    return at_threshold(spread, (*by, "threshold"), F.col("threshold"), y, x)


def peak_f1(sweep: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The row of the largest f1, of equals that of the lowest threshold."""
    cols = [c for c in sweep.columns if c not in by]
    best = sweep.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct("f1", -F.col("threshold"))).alias("b"))
    return best.select(*by, "b.*")


def histogram(df: DataFrame, by: tuple[str, ...], x: str = "x", lo: float = 0.0, hi: float = 100.0, bins: int = 20) -> DataFrame:
    """by, bin (from 1), n, density over [lo, hi], the upper end in the last bin; values outside don't count."""
    inside = df.filter(F.col(x).between(lo, hi)).withColumn("bin", F.least(F.floor((F.col(x) - lo) / ((hi - lo) / bins)) + 1, F.lit(bins)))
    counted = inside.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*by)) * ((hi - lo) / bins)))


def distribution(df: DataFrame, by: tuple[str, ...], x: str = "x") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))


def box_summary(df: DataFrame, by: tuple[str, ...], x: str = "x") -> DataFrame:
    """Exact quartiles, minimum and maximum."""
    q = quantiles(df, by, x, [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(*by, *(F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))))


def mean_recalls(df: DataFrame, fold: str, classes: list[int], y: str = "y", p: str = "p") -> DataFrame:
    """class, folds and recall: the mean over folds of each class's recall; a fold without the class doesn't count, and a
    class in no fold has a null."""
    each = df.groupBy(fold, F.col(y).cast("int").alias("class")).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("r"))
    all_ = df.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    return F.broadcast(all_).join(each.filter(~F.isnan("r")), "class", "left").groupBy("class").agg(F.count("r").alias("folds"), F.avg("r").alias("recall"))


def tool_comparison(df: DataFrame, tools: list[str], threshold: float = 0.5, y: str = "y", x: str = "x", tool: str = "tool") -> DataFrame:
    """tool, auroc, auprc and f1 at the threshold of (tool, y, x); a tool without rows has nulls: nothing is made up."""
    f1 = at_threshold(df, (tool,), F.lit(threshold), y, x).select(tool, "f1")
    out = df.sparkSession.createDataFrame([(t,) for t in tools], f"{tool} string")
    for part in (auroc(df, (tool,), y, x).select(tool, "auroc"), average_precision(df, (tool,), y, x).select(tool, F.col("ap").alias("auprc")), f1):
        out = out.join(part, tool, "left")
    return out


def detection_rates(df: DataFrame, tools: list[str], groups: list[str], threshold: float = 0.5, most_fpr: float = 0.10, y: str = "y", x: str = "x", tool: str = "tool") -> DataFrame:
    """tool, n, rate, and n_g and rate_g of each boolean column g of df(tool, y, x, *groups): the share of the positives, and of
    those in g, with a score of at least the threshold; and calibrated, the largest share that some threshold finds while
    at most most_fpr of the negatives reach it.

    A rate of no records is null, and a tool without rows has nulls and counts of 0: no rate is derived from another. Rows
    with a null score are found by no threshold, and a null in g isn't in the group.
    """
    own, hit = F.col(y) == 1, F.coalesce(F.col(x) >= threshold, F.lit(False)).cast("double")
    parts = {"": own, **{f"_{g}": own & F.coalesce(g, F.lit(False)) for g in groups}}
    found = df.groupBy(tool).agg(*(a for n, c in parts.items() for a in (F.count(F.when(c, 1)).alias(f"n{n}"), F.avg(F.when(c, hit)).alias(f"rate{n}"))))
    points = roc_points(df.filter(F.col(x).isNotNull()), (tool,), y, x)
    # recall among all positives: those without a score count as missed
    scored = df.groupBy(tool).agg((F.count(F.when(own & F.col(x).isNotNull(), 1)) / F.nullif(F.count(F.when(own, 1)), F.lit(0))).alias("_share"))
    best = points.groupBy(tool).agg(F.max(F.when(F.col("fpr") <= most_fpr, F.col("tpr")).otherwise(0.0)).alias("_best"), F.max("tpr").alias("_any"))
    cal = best.join(scored, tool).select(tool, F.when(F.col("_any").isNotNull(), F.col("_best") * F.col("_share")).alias("calibrated"))
    out = df.sparkSession.createDataFrame([(t,) for t in tools], f"{tool} string").join(found, tool, "left").join(cal, tool, "left")
    return out.fillna(0, [f"n{n}" for n in parts])


def evaluation_summary(df: DataFrame, thresholds: list[float], by: tuple[str, ...], y: str = "y", x: str = "x") -> DataFrame:
    """by, auroc, ap, base, and the threshold of the largest f1 with its precision, recall and f1."""
    peak = peak_f1(threshold_sweep(df, thresholds, by, y, x), by).select(*by, "threshold", "precision", F.col("tpr").alias("recall"), "f1")
    return auroc(df, by, y, x).join(average_precision(df, by, y, x), list(by)).join(peak, list(by)).select(*by, "auroc", "ap", "base", "threshold", "precision", "recall", "f1")
