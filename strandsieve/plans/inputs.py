"""The driver's tables as sequences, references, labels and scores."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


_HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver. Python workers learn where this package is, wherever the driver was started."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _HERE not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (path, _HERE) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, source, lang and the cleaned letters of each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq_id"), "source", "lang", T.clean(F.coalesce("text", F.lit(""))).alias("seq"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ref_id"), T.clean(F.coalesce("text", F.lit(""))).alias("seq"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id and label 0, 1 or 2."""
    label = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).otherwise(0)
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), label.alias("label"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, label, y and two composition scores, 6 digits: gc (of all letters) and ns (share of N)."""
    s = sequences(spark, sf_dir).select("seq_id", F.round(T.gc_share("seq"), 6).alias("gc"), F.round(F.coalesce(T.letters("seq", "N") / F.nullif(F.length("seq"), F.lit(0)), F.lit(0.0)), 6).alias("ns"))
    return s.join(labels(spark, sf_dir), "seq_id").withColumn("y", (F.col("label") != 0).cast("int"))


def finished(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Whole numbers as longs, doubles to some digits, or as they are."""
    kinds = {"int": lambda c: F.col(c).cast("long"), "double": lambda c: (F.col(c) if digits is None else F.round(c, digits)) + F.lit(0.0)}
    return df.select(*(kinds[t](c).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))
