import io
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandsieve.llm import token_files

from .fixtures import documents, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bits_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 8, 13, 16, 17, 31, 32):
        ids = rng.integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
        raw = token_files.pack_bits(ids, bits)
        assert len(raw) == -(-1000 * bits // 8)
        assert (token_files.unpack_bits(raw, 1000, bits) == ids).all()
    assert [token_files.width(n) for n in (1, 2, 3, 49408, 65537)] == [1, 1, 2, 16, 17]


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 49408, n).astype("<u4") for n in (0, 5, 40_000, 3, 16_384, 20_000)]
    out = _File()
    w = token_files.TokenWriter(out, 16)
    for i, d in enumerate(docs):
        w.add(i if i else None, d)
    w.finish()
    r = token_files.TokenReader(out)
    whole = np.concatenate(docs)
    assert r.n == len(whole) and r.documents["known"].tolist() == [0, 1, 1, 1, 1, 1]
    for a, n in ((0, 0), (0, 1), (16_383, 3), (100, 50_000), (len(whole) - 1, 1)):
        assert (r.ids(a, n) == whole[a : a + n]).all()


def test_files_hold_all_documents_in_order(spark):
    got = token_files.token_files(documents(spark), PATH).collect()
    t = Tokenizer.from_file(PATH)
    want, at = [], 0
    for i, text in sorted(texts(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((str(i), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


def test_empty_table(spark):
    assert token_files.token_files(documents(spark, []), PATH).count() == 0
