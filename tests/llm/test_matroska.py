import hashlib
import random
import zlib

import pytest

from strandsieve.llm import matroska

from .fixtures import documents, texts


@pytest.mark.parametrize("lacing", list(matroska.LACINGS))
def test_round_trip(lacing):
    r = random.Random(1)
    for n in (192, 384, 192 * 9, 192 * 1025):
        payload = r.randbytes(n)
        raw = matroska.mux(payload, lacing)
        m = matroska.demux(raw)
        assert b"".join(raw[p.start : p.start + p.size] for p in m.packets) == payload
        assert m.tracks == {1: "A_PCM/INT/LIT"} and len(m.cues) == m.clusters and {c[2] for c in m.cues} == {p.cluster for p in m.packets}
        for t in (0, 23, 24, m.packets[-1].timestamp, 10**9):
            want = max(c[0] for c in m.cues if c[0] <= t)
            assert matroska.seek(raw, m, t) == [p for p in m.packets if p.cluster == next(c[2] for c in m.cues if c[0] == want)]
        if lacing == "none":
            assert [p.timestamp for p in m.packets] == [24 * i for i in range(n // 192)]


def test_uneven_frames_by_xiph_and_ebml_lacing():
    r = random.Random(2)
    for lacing in ("xiph", "ebml"):
        for _ in range(200):
            frames = [r.randbytes(r.choice([0, 1, 63, 64, 127, 128, 254, 255, 256, 700, 20_000])) for _ in range(r.randint(2, 9))]
            flags, head = matroska.laced(frames, lacing)
            block = b"\x81\x00\x05" + bytes([0x80 | flags]) + head + b"".join(frames)
            track, rel, _, got = matroska.block_frames(block, 0, len(block))
            assert (track, rel) == (1, 5) and [block[a : a + n] for a, n in got] == frames


def test_unknown_sizes():
    raw = matroska.mux(b"q" * 192 * 3)
    at = raw.index(matroska.CLUSTER.to_bytes(4, "big"))
    size, end = matroska._vint(raw, at + 4, False)
    open_ = raw[: at + 4] + b"\x01" + b"\xff" * 7 + raw[end:]
    seg = open_.index(matroska.SEGMENT.to_bytes(4, "big"))
    _, stop = matroska._vint(open_, seg + 4, False)
    open_ = open_[: seg + 4] + b"\xff" + open_[stop:]
    m = matroska.demux(open_)
    assert b"".join(open_[p.start : p.start + p.size] for p in m.packets) == b"q" * 576 and m.clusters == 1 and len(m.cues) == 1


def test_query_values(spark):
    got = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in matroska.media_features(documents(spark)).collect())
    want = []
    for i, t in texts():
        p = (t or "").encode()
        q = p + b" " * ((-len(p)) % 192 if p else 192)
        want.append((str(i), len(p), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-16:])))
    assert got == sorted(want)


def test_media_and_feature_are_those_of_the_samples(spark):
    got = sorted((str(r.doc_id), r.media_bytes, r.media_sha256, r.feature) for r in matroska.media_features(documents(spark)).collect())
    want = []
    for i, t in texts():
        q = (t or "").encode()
        q += b" " * ((-len(q)) % 192 if q else 192)
        media = matroska.mux(q)
        x = [b - 128 for b in q]
        steps = [(b > a) - (b < a) for a, b in zip(x, x[1:], strict=False)]
        turns = sum(a != b for a, b in zip(steps, steps[1:], strict=False))
        n, blocks = len(q) // 192, -(-len(q) // (192 * 8))
        clusters = -(-blocks // 128)
        want.append((str(i), len(media), hashlib.sha256(media).hexdigest(), f"packets={n};clusters={clusters};cues={clusters};last={(n - 1) // 8 * 8 * 24};sum={sum(x)};energy={sum(v * v for v in x)};turns={turns}"))
    assert got == sorted(want)


def test_packet_table(spark):
    table = matroska.packet_table(matroska.media_column(documents(spark, [(1, "a" * 500), (2, None)]))).orderBy("doc_id", "packet").collect()
    assert [(r.doc_id, r.packet, r.size) for r in table] == [(1, 0, 192), (1, 1, 192), (1, 2, 192), (2, 0, 192)]
    assert matroska.media_features(documents(spark, [])).count() == 0
