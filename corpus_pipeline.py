"""From documents to packed training sequences in five stages.

Stages take and return DataFrames and can be chained. A stage first deletes what stages before it, in the same thread, left in
the shared folder, if its documents are a written table that needs nothing of it: where each result is written and read
again, as run() does, one stage's scratch tables exist at a time. Results of other calls keep their files.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandsieve.llm import exact_dedup, packing, simhash, substring, toxicity
from strandsieve.llm.common import delete, noting, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[tuple[str, int], list[str]] = {}


def stage(f: Stage) -> Stage:
    @wraps(f)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = _left.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])
        # a table as it was read needs nothing of theirs, unless it is one of theirs
        if own and docs._jdf.queryExecution().analyzed().children().isEmpty() and not any(path.rsplit("/", 1)[1] in x for x in docs.inputFiles() for path in own):
            delete(spark, own)
            own.clear()
        with noting(own):
            return f(spark, docs, sf_dir)

    return tidy


@stage
def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Only the text counts, whole. Null and empty texts and documents without a doc_id stay if the model lets them; repeated
    rows and equal texts stay or go together. All columns stay, whatever their names. An empty table stays empty.
    """
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays.

    A null text equals an empty one; a null doc_id is below all others; of rows that repeat the largest doc_id one stays.
    Long texts are compared whole. All columns stay, whatever their names. An empty table stays empty.
    """
    return exact_dedup.keep_exact(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike to 0.8 or more, directly or over others, that with the smallest doc_id
    stays.

    Texts without words, null ones too, and documents without a doc_id stay; rows of one doc_id stay or go together. Long
    texts are read whole. All columns stay, whatever their names. An empty table stays empty.
    """
    return simhash.keep_near(docs)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that also stand in a document with a smaller doc_id are cut out.

    No row goes; a text may become empty, a null one stays null. A document without a doc_id is larger than all others.
    Repeated rows lose the same words. All columns stay, n_chars follows the text. An empty table stays empty.
    """
    return substring.without_repeats(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 with little padding, one row for each piece of a document.

    A null text counts as empty and has the end id alone; null and repeated doc_ids are packed like others. Long texts
    have many pieces; ties go by doc_id and place. An empty table gives no row.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", civil), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", repeats), ("packing", packed)]

#: Tokenisation has no SQL; tests hold the stages against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of sf_dir, each result written and read again; only the last stage's input stays, until
    the driver ends."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "pipeline")
    before: list[str] = []
    for name, f in STAGES[:-1]:
        f(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        delete(spark, before)
        before = [f"{folder}/{name}"]
        docs = spark.read.schema(docs.schema).parquet(*before)
    return STAGES[-1][1](spark, docs, sf_dir)
