import base64
import hashlib

import zstandard

from strandsieve.llm import warc
from strandsieve.llm.common import scratch

ROWS = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>" if i % 3 else f"<p>own {i}</p>") for i in range(60)]
ROWS += [(90, None, None), (91, "u\r\nX: y", ""), (None, "w", ""), (92, "v", "z" * 400_000), (93, "v", "é" * 10), (93, "v", "é" * 10), (94, "v", "é" * 10)]


def pages(spark, rows=None):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)


def expected(least=0):
    low = {}
    for i, _, h in ROWS:
        k = (h or "").encode()
        low[k] = min(low.get(k, 1 << 70), 1 << 69 if i is None else i)
    out = []
    for i, _, h in ROWS:
        k = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(k).digest()).decode()
        first = low[k]
        revisit = len(k) >= least and (1 << 69 if i is None else i) > first
        out.append((str(i), len(k), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    for least in (0, 20):
        got = sorted(((str(r[0]), *r[1:]) for r in warc.warc_roundtrip(pages(spark), least).collect()), key=str)
        assert got == expected(least)


def test_bundles_are_plain_zstd_and_seekable(spark):
    manifest = warc.write_bundles(pages(spark), scratch(spark, "warc-test")).collect()
    assert sum(r.n_records for r in manifest) == len(ROWS)
    ids, referred = [], []
    for r in manifest:
        with warc.reading(r.file) as f:
            raw = f.read(f.size())
            reader = warc.BundleReader(f)
            heads = [reader.record(x[0])[0] for x in reader.index]
            ids += [h["warc-record-id"] for h in heads if h["warc-type"] == "response"]
            referred += [h["warc-refers-to"] for h in heads if h["warc-type"] == "revisit"]
            assert len(reader.places) == len(reader.index) == r.n_records
            for record_id, k, at, size in reader.index[::5]:
                head, _ = reader.record(record_id)
                assert head["warc-record-id"] == f"<{record_id}>"
                assert reader.frame(k)[at : at + 5] == b"WARC/" and size > 0
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == r.n_records and len(plain) == r.raw_bytes
    assert len(set(ids)) == len(ids) and set(referred) <= set(ids)


def test_empty_table(spark):
    assert warc.warc_roundtrip(pages(spark, [])).count() == 0
