import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex

from strandsieve.llm import bpe
from strandsieve.llm.encoding import ByteEncoder, _byte_ranks

from .fixtures import documents, texts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def expected(t):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_byte_ranks(PATH), special_tokens={})
    ids = e.encode_ordinary(t or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 1024), (700, 90), (64, 16)])
def test_digests_equal_the_library(spark, chunk, overlap):
    got = bpe.encoded_digests(documents(spark), PATH, chunk, overlap).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *expected(t)) for i, t in texts())


def test_chunks_without_a_common_boundary_stay_together_with_their_neighbours_only(spark):
    texts_ = {1: "a" * 5000 + " b", 2: "word and word " * 400, 3: "some words " * 300 + "x" * 2500 + "," + " more words" * 300, 4: "日本語。" * 1200}
    rows = spark.createDataFrame([(i, 7, t) for i, t in texts_.items()], "row long, doc_id long, text string")
    got = {}
    for r in sorted(bpe.stitched_pieces(rows, PATH, 1000, 50).collect(), key=lambda r: (r["row"], r["piece"])):
        assert r["piece"] == len(got.setdefault(r["row"], []))
        got[r["row"]].append(r["text"])
    assert {i: "".join(p) for i, p in got.items()} == texts_
    assert len(got[1]) == 1 and len(got[2]) > 3 and len(got[3]) >= 5 and len(got[4]) > 3
    pattern = regex.compile(public_tokenizers.PATTERN)
    for i, pieces in got.items():
        assert [x for p in pieces for x in pattern.findall(p)] == pattern.findall(texts_[i])


def test_pieces_of_random_texts_have_the_pre_tokens_of_the_whole(spark):
    r = random.Random(4)
    rows = [(i, i, "".join(r.choice(["ab", "'s", " ", "  ", "\n", "1", "!?", "é", "x" * r.randint(1, 90)]) for _ in range(r.randint(50, 300)))) for i in range(60)]
    got = {}
    for p in sorted(bpe.stitched_pieces(spark.createDataFrame(rows, "row long, doc_id long, text string"), PATH, 128, 24).collect(), key=lambda p: (p["row"], p["piece"])):
        got.setdefault(p["row"], []).append(p["text"])
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert all([x for p in got[i] for x in pattern.findall(p)] == pattern.findall(t) for i, _, t in rows)


def test_encoded_pieces_decode_to_the_text(spark):
    e = ByteEncoder(PATH)
    got = {}
    for p in sorted(bpe.encoded(documents(spark), PATH, 700, 90).collect(), key=lambda p: (p["row"], p["piece"])):
        got[p["row"]] = got.get(p["row"], b"") + bpe.decode(np.frombuffer(p["ids"], "<u4").tolist(), e.raw)
    assert sorted(got.values()) == sorted((t or "").encode() for _, t in texts())


def test_boundaries_are_those_of_the_whole_text():
    text = "It's  a\n\n test,  isn't it? 12 ab" * 5
    pattern = regex.compile(public_tokenizers.PATTERN)
    whole = {m.end() for m in pattern.finditer(text)}
    assert set(bpe.boundaries(text, pattern)) <= whole


def test_decode_gives_bytes_back():
    e = ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("héllo 👩", "\x00\x1f ", "日本"):
        assert bpe.decode(e.encode(t), e.raw) == t.encode()


def test_json_and_rank_file_have_the_same_ids():
    assert _byte_ranks(PATH) == _byte_ranks(public_tokenizers.path("byte_bpe_50k.json"))


def test_empty_table(spark):
    assert bpe.encoded_digests(documents(spark, []), PATH).count() == 0
