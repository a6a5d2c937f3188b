import duckdb
import pytest

from strandsieve.llm import queries, warc


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), c.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_warc_sql_on_repeated_payloads(spark, tmp_path):
    rows = [(i, f"u{i}", ["", None, "é" * 9, f"<p>{i}</p>"][i % 4]) for i in range(40)] + [(2, "v", "é" * 9)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = c.sql(queries.SQL["op10_warc"])
    got = warc.warc_roundtrip(spark.read.parquet(f"{tmp_path}/pages")).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
