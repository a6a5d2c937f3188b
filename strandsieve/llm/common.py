"""Shared folders, staged tables and Arrow batches for the corpus operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id where rows must be ordered: such rows come last.
NO_ID = 2**63 - 1

_HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_roots: dict[str, str] = {}
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it, as tests do:
    it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def _file_system(spark: SparkSession, path: str):
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's own part of the shared folder, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = f"{shared_dir(spark)}/{app}-{uuid.uuid4().hex}"
        fs, to = _file_system(spark, root)
        fs.mkdirs(to)
        fs.deleteOnExit(to)
        _roots[app] = root
    path = f"{_roots[app]}/{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append(path)
    return path


@contextlib.contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds to paths what scratch() names meanwhile, in this thread."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, to = _file_system(spark, path)
        fs.delete(to, True)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_by_keys(df: DataFrame, key: Column, keys: Column, among: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be among the keys, rows whose key surely isn't), so that only the first are joined.

    The keys' hashes set bits of a map that is broadcast: 16 bits a key, between 128 KB and 32 MB in all; with more than 16
    million keys it lets more and more rows through, which costs only time. A null key surely isn't. df is read twice.
    """
    known = among.filter(keys.isNotNull()).select(keys.alias("key"))
    bits = 1 << min(28, max(20, (16 * known.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    place = lambda c: F.pmod(c, F.lit(32768))
    marks = known.select(at(F.col("key")).alias("m")).distinct()
    maps = marks.groupBy(F.floor(F.col("m") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(place(F.col("m")).cast("int")).alias("bits"))
    seen = df.select(F.struct(*df.columns).alias("row"), F.when(key.isNotNull(), at(key)).alias("m"))
    seen = seen.withColumn("bucket", F.floor(F.col("m") / 32768)).join(F.broadcast(maps), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place(F.col("m")) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.bit_get(byte, F.pmod(F.col("m"), F.lit(8)).cast("int")) == 1, F.lit(False))
    return seen.filter(hit).select("row.*"), seen.filter(~hit).select("row.*")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the Arrow batches that go to Python, as single texts may be very long, where the session's bound is larger; and
    let workers find this package. Both hold for the session from then on: plans read them when they run."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _HERE not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (path, _HERE) if x)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow of a function from batch to columns. make() runs once in each task."""
    out = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(f(b), schema=out)

    return df.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def pa_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string."""
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(","))])


def id_or_last(col: str):
    """The id; null ids stand after all others."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))
