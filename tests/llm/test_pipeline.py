import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from strandsieve.llm import exact_dedup, simhash, toxicity

from .fixtures import documents, texts

NAMES = ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def plain_exact(rows):
    keep = {}
    for i, t in rows:
        keep[t or ""] = max(keep.get(t or "", i), i)
    return [(i, t) for i, t in rows if keep[t or ""] == i]


def plain_near(rows, similarity=0.8):
    """Groups of documents whose sets of five-word shingles are alike; the smallest id of each stays."""
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = top(rows[a][0]), top(rows[b][0])
                root[max(x, y)] = min(x, y)
    return [(i, t) for i, t in rows if top(i) == i]


def plain_repeats(rows, window=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    low = {}
    for i, w in words.items():
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            low[k] = min(low.get(k, i), i)
    out = []
    for i, t in rows:
        w, keep = words[i], [True] * len(words[i])
        for j in range(len(w) - window + 1):
            if low[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        out.append((i, t if all(keep) else " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    return out


def test_run_is_the_plain_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in rejected)
    rows = plain_repeats(plain_near(plain_exact(rows)))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, a, zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "ids_crc32", "doc_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    names = ("_m", "_bucket", "_hit", "_gone", "_sub_d", "bits", "bucket", "m", "d", "digest", "best", "part", "parts", "left", "doc", "x", "salt", "row_no", "keep_row")
    docs = documents(spark).withColumns({n: F.lit(n) for n in names})
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, docs, sf_dir)
        rows = got.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == {i for i, _ in texts()}
        else:
            assert got.columns == docs.columns and rows and all(r[n] == n for r in rows for n in names)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, sf_dir)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


def test_an_older_result_still_reads(spark, sf_dir):
    docs = documents(spark)
    older = exact_dedup.exact_dedup(docs), simhash.simhash_components(docs)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).count()
    assert [df.count() for df in older] == [len(texts())] * 2


def test_stages_can_be_chained(spark, sf_dir):
    chained = documents(spark)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        chained = stage(spark, chained, sf_dir)
    chained = sorted(map(str, chained.collect()))
    by_step = documents(spark)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        by_step = spark.createDataFrame(stage(spark, by_step, sf_dir).collect(), by_step.schema)
    assert chained == sorted(map(str, by_step.collect()))
