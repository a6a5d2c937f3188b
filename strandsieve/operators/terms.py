"""k-mers, tokens and bigrams as numbers, counted by numpy in Arrow batches: no row is made for each place of a sequence.

Letters A, C, G, N and T are digits in this order, so numbers of one length go in the order of the strings. Rows with other letters
are counted as strings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LETTERS = b"ACGNT"
_DIGIT = np.zeros(256, np.int64)
_DIGIT[list(LETTERS)] = range(5)
_DIGITS = str.maketrans("ACGNT", "01234")
_TERM = re.compile(r"k(\d+)_([ACGNT]+)(?: k(\d+)_([ACGNT]+))?")
#: The longest k-mer whose number fits beside that of a piece's row, and letters and rows of one piece.
LONGEST, PIECE, ROWS = 20, 1 << 18, 1 << 12
#: Of pieces whose terms are counted, so that what is made of them stays in a core's cache.
SMALL = 1 << 15, 1 << 9
#: The longest k-mer whose number fits into 32 bits.
SHORT = 13


def sorted_by(rows: DataFrame, by: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """Rows dealt out by their key, in so many parts if given, those of one key together; without a key as they are."""
    return (rows.repartition(parts, *by) if parts else rows.repartition(*by)).sortWithinPartitions(*by) if by else rows


def whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], text: str, most: tuple[int, int] = (PIECE, ROWS)) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Pieces of rows that are sorted by their key, with the number of each row's key in the piece; a key's rows stay together.
    Without a key each row is one of its own. Pieces have about so many letters and rows at most, or one key."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        if by:
            new[1:] = False
            for c in by:
                code = t.column(c).combine_chunks().dictionary_encode("encode")
                code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(new)
        last = int(starts[-1]) if by else len(t)
        held = t.slice(last) if by else None
        yield from _pieces(t.slice(0, last), starts[starts < last], text, most)
    if held is not None:
        yield from _pieces(held, np.zeros(1, np.int64), text, most)


def _pieces(t: pa.Table, starts: np.ndarray, text: str, most: tuple[int, int]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    letters = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(t.column(text)), 0).to_numpy())])
    ends, a = np.append(starts[1:], len(t)), 0
    while a < len(starts):
        z = max(a + 1, min(int(np.searchsorted(letters[ends], letters[starts[a]] + most[0])), a + most[1]))
        z = min(z, len(starts))
        lo, hi = int(starts[a]), int(ends[z - 1])
        group = np.zeros(hi - lo, np.int64)
        group[starts[a + 1 : z] - lo] = 1
        yield t.slice(lo, hi - lo), np.cumsum(group)
        a = z


def parted(column: pa.ChunkedArray) -> tuple[list[str], list[tuple[int, str]]]:
    """The rows' strings, with an empty one for null ones and those with other letters, and the latter with their places."""
    known = pc.fill_null(pc.match_substring_regex(column, "^[ACGNT]*$"), True).to_numpy(zero_copy_only=False)
    rows = [x or "" for x in column.to_pylist()]
    odd = [(int(i), rows[i]) for i in np.flatnonzero(~known)]
    for i, _ in odd:
        rows[i] = ""
    return rows, odd


def numbers(rows: list[str], lengths: set[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Each letter's row, its place there, the letters from it to the row's end, and the k-mers that start there by k (where so many letters follow)."""
    sizes = np.array(list(map(len, rows)), np.int64)
    # half the bytes where all fits
    kind = np.int32 if max(lengths) <= SHORT and sizes.sum() < 1 << 31 else np.int64
    ends = np.cumsum(sizes).astype(kind)
    row = np.repeat(np.arange(len(rows), dtype=kind), sizes)
    digit = _DIGIT.astype(kind)[np.frombuffer("".join(rows).encode(), np.uint8)]
    at = np.arange(len(digit), dtype=kind)
    left, place = ends[row] - at, at - (ends - sizes.astype(kind))[row]
    found, code = {}, np.zeros(len(digit), kind)
    for k in range(1, max(lengths) + 1):
        # what a row's end cuts off is nonsense, and not read
        code = code * 5
        code[: max(0, len(digit) - k + 1)] += digit[k - 1 :]
        if k in lengths:
            found[k] = code
    return row, place, left, found


def spelled(code: np.ndarray, k: int) -> np.ndarray:
    """The letters of k-mers, a row of bytes for each."""
    return np.frombuffer(LETTERS, np.uint8)[code[:, None] // 5 ** np.arange(k - 1, -1, -1) % 5]


def strings(letters: np.ndarray) -> pa.Array:
    n, size = letters.shape
    # parts of one array stay within 32-bit offsets
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and where they start."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[starts], starts


def kmer_rows(t: pa.Table, group: np.ndarray, k: int, text: str) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, k-mer, count and first place of the k-mers of a piece, by group and k-mer."""
    rows, odd = parted(t.column(text))
    if k > LONGEST:
        rows, odd = [], list(enumerate(x or "" for x in t.column(text).to_pylist()))
    if odd:
        counts, first = Counter(), {}
        for i, x in [*odd, *((i, x) for i, x in enumerate(rows) if x)]:
            for a in range(len(x) - k + 1):
                one = int(group[i]), x[a : a + k]
                counts[one] += 1
                first[one] = min(a, first.get(one, a))
        found = sorted(counts)
        return np.array([g for g, _ in found], np.int64), pa.array([x for _, x in found], pa.string()), np.array([counts[x] for x in found], np.int64), np.array([first[x] for x in found], np.int64)
    row, place, left, codes = numbers(rows, {k})
    ok = left >= k
    key, place = group[row[ok]] * 5**k + codes[k][ok], place[ok].astype(np.int64)
    order = np.argsort(key, kind="stable")
    one, starts = runs(key[order])
    cnt = np.diff(np.append(starts, len(key)))
    first = np.minimum.reduceat(place[order], starts) if len(starts) else place
    return one // 5**k, strings(spelled(one % 5**k, k)), cnt, first


def shares(rows: list[str | None]) -> np.ndarray:
    """gc, cpg and gc3 of rows, as the column functions of these names have them."""
    ascii_ = [(x or "").encode("ascii", "replace") for x in rows]
    sizes = np.array(list(map(len, ascii_)), np.int64)
    ends = np.cumsum(sizes)
    b, place = np.frombuffer(b"".join(ascii_), np.uint8), np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
    strong = (b == ord("G")) | (b == ord("C"))
    pairs = np.append((b[:-1] == ord("C")) & (b[1:] == ord("G")) & (place[1:] > 0), False)[: len(b)]

    def per(found: np.ndarray, of: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(found)])
        return (so_far[ends] - so_far[ends - sizes]) / np.maximum(of, 1)

    gc = per(strong, sizes)
    return np.stack([gc, per(pairs, sizes - 1), np.where(sizes >= 3, per(strong & (place % 3 == 2), sizes // 3), gc)], axis=1)


class Terms:
    """The tokens k{k}_{kmer} of fragments for each k, in this order, and with pairs the bigrams of neighbours."""

    def __init__(self, ks: tuple[int, ...], pairs: bool = True):
        self.ks, self.pairs = tuple(ks), pairs
        kinds = [(k, 0) for k in self.ks] + ([(k, k) for k in self.ks] + list(pairwise(self.ks)) if pairs else [])
        spans = [5 ** (a if not b else a + 1 if a == b else a + b) for a, b in kinds]
        self.start, at = {}, 0
        for kind, span in zip(kinds, spans, strict=True):
            self.start[kind], at = at, at + span
        self.plain = list(self.ks) == sorted(set(self.ks)) and min(self.ks) > 0 and at < 1 << 49
        self.span = at if self.plain else 1
        #: numbers below come from one k-mer each
        self.near = self.start[self.ks[0], self.ks[1]] if pairs and len(self.ks) > 1 and self.ks[0] != self.ks[1] else at

    def strings_of(self, frag: str) -> list[str]:
        tokens = [f"k{k}_{frag[i : i + k]}" for k in self.ks for i in range(len(frag) - k + 1)]
        return [*tokens, *map(" ".join, pairwise(tokens))] if self.pairs else tokens

    def of(self, column: pa.ChunkedArray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], list[tuple[int, str]]]:
        """Row and number of every term of the rows, first of those numbered below near, then of the few others; and the rows with other
        letters, whose terms have no number."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not self.plain:
            return none, none, [(i, x) for i, x in enumerate(column.to_pylist()) if x]
        rows, odd = parted(column)
        row, place, left, codes = numbers(rows, {*self.ks, *(k + 1 for k in self.ks if self.pairs)})
        near = []
        for k in self.ks:
            for size, kind in ((k, (k, 0)), (k + 1, (k, k))) if self.pairs else ((k, (k, 0)),):
                ok = left >= size
                code = codes[size] if self.near < 1 << 31 else codes[size].astype(np.int64)
                near.append((row[ok], code[ok] + self.start[kind]))
        far = [none]
        for a, b in pairwise(self.ks) if self.pairs else ():
            # the last token of one length and the first of the next
            ends = np.flatnonzero((left == a) & (left + place >= b))
            starts = ends - place[ends]
            far.append((row[ends], codes[a][ends].astype(np.int64) * 5**b + codes[b][starts] + self.start[a, b]))
        near, far = (tuple(map(np.concatenate, zip(*x, strict=True))) for x in (near, far))
        return near, far, odd

    def names(self, ids: np.ndarray) -> pa.Array:
        """The terms of numbers."""
        kinds, starts = list(self.start), np.array(list(self.start.values()))
        order = np.argsort(ids, kind="stable")
        ordered, out = ids[order], []
        cuts = np.append(np.searchsorted(ordered, starts), len(ids))
        for (a, b), start, lo, hi in zip(kinds, starts, cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            code = ordered[lo:hi] - start
            if not b:
                both = [(a, spelled(code, a))]
            elif a == b:
                letters = spelled(code, a + 1)
                both = [(a, letters[:, :-1]), (a, letters[:, 1:])]
            else:
                both = [(a, spelled(code // 5**b, a)), (b, spelled(code % 5**b, b))]
            parts = []
            for i, (k, letters) in enumerate(both):
                head = np.frombuffer(f"{' ' if i else ''}k{k}_".encode(), np.uint8)
                parts += [np.broadcast_to(head, (hi - lo, len(head))), letters]
            out.append(strings(np.concatenate(parts, axis=1)))
        if not out:
            return pa.array([], pa.string())
        back = np.empty(len(ids), np.int64)
        back[order] = np.arange(len(ids))
        return pa.concat_arrays(out).take(pa.array(back))

    def number(self, term: str) -> int:
        """A term's number, -1 for one without."""
        m = self.plain and _TERM.fullmatch(term)
        if not m:
            return -1
        a, x = int(m[1]), m[2]
        value = lambda s: int(s.translate(_DIGITS), 5)
        if len(x) != a or (m[3] and len(m[4]) != int(m[3])):
            return -1
        if not m[3]:
            return self.start[a, 0] + value(x) if (a, 0) in self.start else -1
        b, y = int(m[3]), m[4]
        if (a, b) not in self.start or (a == b and x[1:] != y[:-1]):
            return -1
        return self.start[a, b] + (value(x + y[-1]) if a == b else value(x + y))

    def counted(self, t: pa.Table, group: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[tuple[int, str], int]]:
        """Group, number and count of the terms of a piece; and the counts of those without a number, which
        may be the rest of a term that has one, too."""
        near, far, odd = self.of(t.column(text))
        own, ids, tf = map(np.concatenate, zip(*(tallied(group[row], x, size) for (row, x), size in ((near, self.near), (far, self.span))), strict=True))
        rest: Counter = Counter()
        for i, x in odd:
            for term in self.strings_of(x):
                rest[int(group[i]), term] += 1
        if rest and self.plain:
            # terms of known letters alone in rows with others have numbers
            known = {term: self.number(term) for _, term in rest}
            more = [(g * self.span + known[term], n) for (g, term), n in rest.items() if known[term] >= 0]
            key, tf = summed(np.concatenate([own * self.span + ids, np.array([x for x, _ in more], np.int64)]), np.concatenate([tf, np.array([n for _, n in more], np.int64)]))
            own, ids, rest = key // self.span, key % self.span, {x: n for x, n in rest.items() if known[x[1]] < 0}
        return own, ids, tf, dict(rest)


def tallied(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, number (below size) and count of what stands in the groups, by group and number."""
    kind = np.int32 if (int(group.max(initial=0)) + 1) * size < 1 << 31 else np.int64
    key, starts = runs(np.sort(group.astype(kind) * kind(size) + ids.astype(kind)))
    own = key // kind(size)
    return own.astype(np.int64), (key - own * kind(size)).astype(np.int64), np.diff(np.append(starts, len(group)))


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    one, starts = runs(key[order])
    return one, *(np.add.reduceat(v[order], starts) if len(starts) else v for v in values)


class Vocabulary:
    """Columns of terms, looked up by number."""

    def __init__(self, terms: Terms, names: list[str]):
        self.terms, self.names = terms, names
        ids = np.array([terms.number(x) for x in names], np.int64)
        column = np.flatnonzero(ids >= 0)
        order = np.argsort(ids[column], kind="stable")
        self.ids, self.columns = ids[column][order], column[order]

    def open(self) -> Vocabulary:
        """Makes its tables, in the task that reads it."""
        self.named = {x: i for i, x in enumerate(self.names)}
        size = self.terms.near if self.terms.plain and self.terms.near <= 1 << 24 else 0
        self.table = np.full(size, -1, np.int32)
        self.table[self.ids[self.ids < size]] = self.columns[self.ids < size]
        return self

    def column(self, ids: np.ndarray) -> np.ndarray:
        """Columns of numbers, -1 for terms outside."""
        if ids.dtype == np.int32 and self.terms.near <= len(self.table):
            return self.table[ids]
        out, direct = np.full(len(ids), -1, np.int64), ids < len(self.table)
        out[direct] = self.table[ids[direct]]
        if len(self.ids) and not direct.all():
            rest = ids[~direct]
            at = np.minimum(np.searchsorted(self.ids, rest), len(self.ids) - 1)
            out[~direct] = np.where(self.ids[at] == rest, self.columns[at], -1)
        return out

    def counted(self, t: pa.Table, group: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, column and count of the vocabulary's terms in a piece, by group and column."""
        near, far, odd = self.terms.of(t.column(text))
        size, found = max(1, len(self.names)), []
        for row, ids in (near, far):
            column = self.column(ids)
            keep = column >= 0
            found.append((group[row[keep]], column[keep]))
        own, column, tf = tallied(*map(np.concatenate, zip(*found, strict=True)), size)
        if odd:
            more = [int(group[i]) * size + c for i, x in odd for term in self.terms.strings_of(x) if (c := self.named.get(term)) is not None]
            key, tf = summed(np.concatenate([own * size + column, np.array(more, np.int64)]), np.concatenate([tf, np.ones(len(more), np.int64)]))
            own, column = key // size, key % size
        return own, column, tf

    def weighted(self, t: pa.Table, group: np.ndarray, text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, column and weight (1 + ln tf) idf, scaled to length 1 in each group."""
        own, column, tf = self.counted(t, group, text)
        w = (1 + np.log(tf)) * idf[column] if len(tf) else np.empty(0)
        norm = np.sqrt(np.bincount(own, w * w)) if len(tf) else w
        return own, column, w / norm[own]
