import random
import zlib

import numpy as np
import public_tokenizers

from strandsieve.llm import packing
from strandsieve.llm.encoding import WordEncoder

from .fixtures import documents, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_first_fit_decreasing_is_the_plain_one():
    r = random.Random(5)
    for n in (0, 1, 2, 7, 300):
        sizes = np.array([r.randint(1, 64) for _ in range(n)], np.int64)
        bins, offsets = packing.first_fit_decreasing(sizes, 64)
        room, want = [], {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b = next((b for b, x in enumerate(room) if x >= sizes[i]), None)
            if b is None:
                room.append(64)
                b = len(room) - 1
            want[i] = (b, 64 - room[b])
            room[b] -= sizes[i]
        assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist(), strict=True)] == [want[i] for i in range(n)]


def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = packing.pack(documents(spark), PATH, length=256, group_docs=40).collect()
    want = []
    for i, text in texts():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(str(i), a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()), len(ids)) for a in range(0, len(ids), 256)]
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_word_encoder_is_the_library():
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(2)
    odd = ["".join(r.choice("ab'SsΣé1²ªµ×.,!\xa0  \n\x1cİſ") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    odd += [None, "", "<|endoftext|> it's", "a<|endoftext|>B É<|startoftext|>", "<|ENDOFTEXT|>", "<| endoftext |>"]
    for t, raw in zip(odd, e.encode(odd), strict=True):
        assert np.frombuffer(raw, e.dtype).tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids
