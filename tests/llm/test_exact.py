import hashlib

from pyspark.sql import functions as F

from strandsieve.llm import exact_dedup

from .fixtures import documents, texts


def expected():
    groups = {}
    for i, t in texts():
        groups.setdefault(t or "", []).append(i)
    keep = {t: max(ids, key=lambda i: -1 if i is None else i) for t, ids in groups.items()}
    return sorted((str(i), str(keep[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts())


def rows(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in df.collect())


def test_equals_brute_force(spark):
    got = exact_dedup.exact_dedup(documents(spark))
    assert rows(got) == expected()
    kept = got.filter("kept").groupBy("text_sha256").count().collect()
    assert {r["count"] for r in kept} == {1} and len(kept) == len({t or "" for _, t in texts()})


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    weak = exact_dedup.exact_dedup(documents(spark), digest=lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1).cast("binary"))
    assert rows(weak) == expected()


def test_state_goes_on(spark, tmp_path):
    all_ = documents(spark).filter("doc_id IS NOT NULL").select("doc_id", "text")
    folder = f"file://{tmp_path}/state"
    exact_dedup.exact_dedup(all_.filter("doc_id % 2 = 0"), folder).count()
    got = exact_dedup.exact_dedup(all_.filter("doc_id % 2 = 1"), folder)
    assert rows(got) == rows(exact_dedup.exact_dedup(all_))


def test_stage_keeps_columns(spark):
    docs = documents(spark)
    got = exact_dedup.keep_exact(docs)
    assert got.columns == docs.columns and got.count() == len({t or "" for _, t in texts()})


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    assert exact_dedup.keep_exact(documents(spark, [])).count() == 0


def test_plan_has_no_python(spark):
    plan = exact_dedup.exact_dedup(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
