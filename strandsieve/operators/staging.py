"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, for what several later steps read: it isn't made again for each, and its plan isn't
    planned again with each. The folder is spark.checkpoint.dir; only a local session may do without it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstaged(spark: SparkSession, *done: DataFrame) -> None:
    """Removes the staged tables that these read, when nothing reads them any more, and lets Spark remove the shuffle files of what is done: it
    does so only for what the driver's collector has found to be out of use, which in long runs of fits comes too late."""
    for df in done:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[0].endswith(_own[spark.sparkContext.applicationId].rsplit("/", 1)[1]):
                to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not found and master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{found.rstrip('/')}/{app}-{uuid.uuid4().hex}" if found else "file://" + tempfile.mkdtemp(prefix="spark-staged-")
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(to)
        fs.deleteOnExit(to)
        _own[app] = root
    return f"{_own[app]}/{name}-{uuid.uuid4().hex}"
