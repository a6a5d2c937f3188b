"""Whole texts to token ids by public vocabularies.

ByteEncoder: a byte-level vocabulary, ranks or a tokenizers file, as a tiktoken encoding; both files give the same ids.
WordEncoder: the tokenizers library on a vocabulary with word ends, through a cache. There white space parts words for
good, and texts of ASCII and Latin-1 letters are cut into pre-tokens, so each distinct pre-token is encoded once and the
ids of the pre-tokens in a row are those of the text. Any other word goes to the library as it is, and so does a whole
text with a special token's literal. What the cache forgets changes no result.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread in each task

#: Unicode's White_Space, as the pre-tokenisers' \s; the letters and white space of simple texts.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS, BLANKS = "A-Za-zÀ-ÖØ-öø-ÿ", "\t-\r "
_WORD = re.compile(f"[^{WHITE}]+")
_SIMPLE = re.compile(f"[\x00-\x7f{LETTERS}]*")
#: The pre-tokens of simple texts in lower case.
_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{BLANKS}0-9{LETTERS}]+")
#: Entries of a cache in a worker before it is set aside; those set aside are forgotten when it is full again.
CACHE = 400_000


def _simple(text: str) -> bool:
    return text.isascii() or _SIMPLE.fullmatch(text) is not None


class WordEncoder:
    """Ids of texts as bytes, of the narrowest of two and four for each id (dtype), little-endian."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}

    def _library(self, pieces: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(pieces), 2000):
            out += [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(pieces[i : i + 2000], add_special_tokens=False)]
        return out

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if _simple(w)]
        for i in range(0, len(plain), 4000):
            part = plain[i : i + 4000]
            ids = self._library([" ".join(part)])[0]
            # the last id of each pre-token says so
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
            raw, at = ids.tobytes(), [0, *ends.tolist()]
            if len(ends) == len(part):
                self.known.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
            else:
                self.known.update(zip(part, [x.tobytes() for x in self._library(part)], strict=True))
        if len(plain) < len(new):
            odd = [w for w in new if not _simple(w)]
            self.known.update(zip(odd, [x.tobytes() for x in self._library(odd)], strict=True))

    def _pieces(self, text: str) -> list[str]:
        if _simple(text):
            return _TOKENS.findall(text.lower())
        # letter case is only folded in advance where that is plain
        return [p for w in _WORD.findall(text) for p in (_TOKENS.findall(w.lower()) if _simple(w) else (w,))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """A null text is empty and has no ids."""
        whole = {k: t for k, t in enumerate(texts) if t and any(s in t for s in self.special)}
        rows = [() if k in whole else self._pieces(t or "") for k, t in enumerate(texts)]
        if len(self.known) > CACHE:
            self.known, self.aside = {}, self.known
        if new := set().union(*rows) - self.known.keys():
            back = new & self.aside.keys()
            self.known.update((w, self.aside[w]) for w in back)
            self._learn(list(new - back))
        get = self.known.__getitem__
        out = [b"".join(map(get, r)) for r in rows]
        for k, ids in zip(whole, self._library(list(whole.values())), strict=True):
            out[k] = ids.tobytes()
        return out


def _byte_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token, from a rank file or a byte-level tokenizers file; special tokens are left out."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {x["content"] for x in whole["added_tokens"]}
    # letters stand for bytes: printable Latin-1 for themselves, the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(byte[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}


def _special(path: str) -> dict[str, int]:
    """The special tokens of a tokenizers file; a rank file has none."""
    if path.endswith(".tiktoken"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


class ByteEncoder:
    """A tiktoken encoding, and each token's bytes and decimal id: encode() knows no special tokens, encode_all() takes the
    literals of the file's special tokens in a text as those tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = _byte_ranks(path)
        self.pattern = public_tokenizers.PATTERN
        special = _special(path)
        both = tiktoken.Encoding(path, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
        self.encode = both.encode_ordinary
        self.encode_all = lambda t: both.encode(t, allowed_special="all") if any(x in t for x in special) else both.encode_ordinary(t)
        size = max(ranks.values()) + 1
        self.raw = [b""] * size
        for token, i in ranks.items():
            self.raw[i] = token
        self.decimal = list(map(str, range(size)))


_encoders: dict = {}


def encoder(kind: type, path: str):
    """The encoder of a vocabulary file, one for each worker process."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
