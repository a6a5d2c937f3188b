"""Exact deduplication as a stateful stream, native to Spark SQL.

The rows are appended to a content table in the shared folder. A Structured Streaming query reads that table and
keeps, per SHA-256 digest and without expiry, a state in RocksDB: the number of rows, the stable identifier of the
row that stays and the locator (file, row number) of its content. A later call with the same folder goes on from
that state. Every hit is then held against the full bytes of the row that stays, so that a digest collision
separates into groups of its own. The comparison reads the content table in bulk; the locator serves readers that want
one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged

#: The state lives on disk. Its many small stores reserve no space ahead, share a bounded memory on each executor, and are
#: closed when a task has committed its store, so that none stays in memory for a batch that never comes.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}
#: Rows of one digest that a task compares with a copy of the text that stays.
PART = 128


def digest_state(content_path: str, schema, checkpoint: str, spark) -> DataFrame:
    """Bring the keyed state up to date with the content table; return it as (digest, group_size, keep, locator)."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).parquet(content_path)
        best = F.max(F.struct("doc_id", "row_no", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index")).alias("locator")))
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").load(checkpoint)
        kept = kept.selectExpr("key.digest AS digest", "value.*").toDF("digest", "group_size", "best")
        return kept.selectExpr("digest", "group_size", "best.doc_id AS keep_id", "best.row_no AS keep_row", "best.locator AS locator")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _ingest(docs: DataFrame, folder: str, digest, carry: bool) -> DataFrame:
    """Append docs to the content table and return the whole table. carry: with all columns of docs, as a struct."""
    spark = docs.sparkSession
    first = 0
    if _exists(spark, f"{folder}/content"):
        first = (spark.read.parquet(f"{folder}/content").agg(F.max("row_no")).first()[0] or 0) + 1
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    content = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *row)
    content = content.withColumns({"row_no": F.monotonically_increasing_id() + first, "text_sha256": F.unhex(F.sha2("text", 256)), "digest": digest(F.col("text"))})
    content.write.mode("append").parquet(f"{folder}/content")
    return spark.read.schema(content.schema).parquet(f"{folder}/content")


def _exists(spark, path: str) -> bool:
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to)


def _sha256(text):
    return F.unhex(F.sha2(text, 256))


def _judged(stored: DataFrame, folder: str) -> DataFrame:
    spark = stored.sparkSession
    state = digest_state(f"{folder}/content", stored.schema, f"{folder}/state", spark)

    # full bytes of each hit against those of the row that stays; a copy of that text goes to each part of a large group
    several = state.filter("group_size > 1").select("digest", "keep_row", F.ceil(F.col("group_size") / PART).cast("int").alias("parts"))
    hits = staged(stored.select("digest", "row_no", "doc_id", "text").join(several, "digest"), "exact-hits")
    stays = hits.filter("row_no = keep_row").select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("kept_text"))
    others = hits.filter("row_no <> keep_row").withColumn("part", F.pmod(F.xxhash64("row_no"), F.col("parts")).cast("int"))
    differ = staged(others.join(stays, ["digest", "part"]).filter("text <> kept_text").select("digest"), "exact-differ")
    collided = staged(differ.distinct(), "exact-collided")

    narrow = stored.select("doc_id", "row_no", "digest", F.lower(F.hex("text_sha256")).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"))
    if collided.isEmpty():
        return narrow.join(state.select("digest", "keep_id", "keep_row", "group_size"), "digest")
    shared = hits.join(collided, "digest").select("digest", "text", "doc_id", "row_no")
    apart = shared.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("best"))
    rows = shared.join(apart, ["digest", "text"]).select("doc_id", "row_no", "digest", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row"), "group_size")
    return narrow.join(collided, "digest", "left_anti").join(state.select("digest", "keep_id", "keep_row", "group_size"), "digest").unionByName(rows)


def exact_dedup(docs: DataFrame, folder: str | None = None, digest=_sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row with the largest doc_id
    stays; a null doc_id stands below all others, and of rows that repeat the largest doc_id exactly one stays. An
    empty table gives an empty result; other columns play no part. folder: where the content table and the state
    live; a second call with the same folder adds its rows to the first's and judges all. digest: function of the
    text column to a binary digest; tests pass a weak one.
    """
    folder = folder or scratch(docs.sparkSession, "exact")
    found = _judged(_ingest(docs, folder, digest, carry=False), folder)
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256", "n_bytes")


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of docs."""
    folder = scratch(docs.sparkSession, "exact")
    stored = _ingest(docs, folder, _sha256, carry=True)
    gone = _judged(stored, folder).filter("row_no <> keep_row").select("row_no")
    return stored.join(gone, "row_no", "left_anti").select("row.*")
