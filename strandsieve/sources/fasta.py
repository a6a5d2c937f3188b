"""FASTA, hit tables, id lists and prediction matrices in; FASTA, text and CSV out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The twelve columns of a headerless hit table.
HIT_SCHEMA = "query_id string, subject_id string, percent_identity double, alignment_length int, mismatches int, gap_opens int, q_start int, q_end int, s_start int, s_end int, evalue double, bit_score double"


def read_fasta(spark: SparkSession, path: str | list[str], least: int = 0, most: int | None = None, label: int | None = None) -> DataFrame:
    """seq_id, description, seq (as written, without line ends), source_file.

    A record may span any number of lines; what stands before a file's first ">" is dropped. most counts a file's
    records before least filters their lengths. Files are split by Spark between records.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("_o"))
    # every split but a file's first begins after a ">"; only the first may be text before any record
    firsts = raw.groupBy("source_file").agg(F.min("_o").alias("_first"))
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", ""), "\n", 2)
    out = raw.join(firsts, "source_file").filter((F.col("_o") != F.col("_first")) | F.col("value").startswith(">"))
    out = out.select("source_file", "_o", F.trim(F.get(lines, F.lit(0))).alias("header"), F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), "\\s", "").alias("seq"))
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("source_file").orderBy("_o"))).filter(F.col("_n") <= most)
    out = out.filter((F.col("header") != "") & (F.length("seq") >= least))
    got = out.select(F.substring_index("header", " ", 1).alias("seq_id"), F.col("header").alias("description"), "seq", "source_file")
    return got if label is None else got.withColumn("label", F.lit(label))


def read_labelled(spark: SparkSession, sources: dict[str, int], least: int = 4, most: dict[str, int] | None = None) -> DataFrame:
    """Union of FASTA files with a label each; most caps the records of some."""
    out = None
    for path, label in sources.items():
        part = read_fasta(spark, path, least, (most or {}).get(path), label)
        out = part if out is None else out.unionByName(part)
    return out


def tagged(parts: dict[str, DataFrame], tag: str = "SRC") -> DataFrame:
    """Union of records with their source in the description."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("description", F.concat("description", F.lit(f" {tag}={name}")))
        out = one if out is None else out.unionByName(one)
    return out


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "description", F.lit("\n"), "seq").alias("value")).write.text(path)


def fasta_stats(df: DataFrame, by: str = "source_file") -> DataFrame:
    """records and total, least, mean and most letters by file."""
    n = F.length("seq")
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(n), F.lit(0)).alias("total_bp"), F.coalesce(F.min(n), F.lit(0)).alias("min_bp"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_bp"), F.coalesce(F.max(n), F.lit(0)).alias("max_bp"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HIT_SCHEMA).csv(path)


def read_hit_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a CSV file: the first of query_id, id and sequence_id that it has, in any case."""
    df = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in df.columns}
    col = next(names[n] for n in ("query_id", "id", "sequence_id") if n in names)
    return df.select(F.col(f"`{col}`").cast("string").alias("id")).distinct()


def read_predictions(spark: SparkSession, path: str, ids: DataFrame, tools: dict[str, str]) -> DataFrame:
    """(seq_id, tool, pred) for ids(seq_id) and the tools (name to column) that the file has; a missing id counts 0."""
    df = spark.read.option("header", True).csv(path)
    have = {t: c for t, c in tools.items() if c in df.columns}
    long = df.select(F.col(f"`{df.columns[0]}`").cast("string").alias("seq_id"), F.explode(F.array(*(F.struct(F.lit(t).alias("tool"), F.col(f"`{c}`").cast("int").alias("pred")) for t, c in have.items()))).alias("t")).select("seq_id", "t.*")
    grid = ids.select(F.col("seq_id").cast("string").alias("seq_id")).crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in have], "tool string")))
    return grid.join(long, ["seq_id", "tool"], "left").select("seq_id", "tool", F.coalesce("pred", F.lit(0)).alias("pred"))


def read_results(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Saved result tables (CSV with a header) by name, those that are there; a missing one is left out."""
    found = {}
    for name, path in paths.items():
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to):
            found[name] = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return found


def read_tests(spark: SparkSession, sources: dict[str, int], least: int = 4) -> DataFrame:
    """Union of labelled FASTA files all of which must be there."""
    for path in sources:
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to):
            raise FileNotFoundError(f"test set {path} is missing")
    return read_labelled(spark, sources, least)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with a header, doubles to some digits."""
    df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)).write.option("header", True).csv(path)


def write_evidence(df: DataFrame, path: str, col: str = "evidence") -> None:
    df.select(F.col(col).alias("value")).write.text(path)
