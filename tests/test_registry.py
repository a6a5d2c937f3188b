import duckdb
import pytest

import __spark_entry__ as registry

#: Queries whose models take long; test_models and test_screening hold their parts.
SLOW = {"cv_predictions", "cv_auroc", "screen_risk", "isotonic_calibrated", "window_sweep", "risk_track", "metrics_table", "screen", "screen_saved", "iforest_scores", "ood_calibrated", "ood_platt", "ood_dual", "ood_track", "ood_sanity", "saliency"}
NAMES = sorted(n for n in registry.catalog.QUERIES if n not in SLOW)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    text = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    a = sorted(tuple(text(r[c]) for c in cols) for r in rows)
    at = [want.columns.index(c) for c in cols]
    assert a == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert registry.entry(spark).columns == ["seq_id", "rank", "kmer", "cnt", "first_pos", "fold"]
