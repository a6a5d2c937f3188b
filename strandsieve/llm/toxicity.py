"""Toxicity scores: a learned lexicon, Levenshtein automata over its trie, and scores of the hits' context.

The lexicon is learned from labelled texts: whole words and word stems (prefixes) that toxic texts hold far more often
than others, in many contexts. Words are read through the Levenshtein automata of all terms at once, run along the
lexicon's trie: a state is the set of (trie node, edits so far) that a word's first letters allow, and the states that occur
are kept with their moves. Letters that changed places are one edit. Words near a term that clean labelled texts hold are
no hits. Words with signs for letters (id!ot) are read whole, and letters parted by signs (i.d.i.o.t) without the signs. A
hit is plain, misspelled, quoted, reported or addressed to someone; sums of each kind are the features of a logistic regression
with coefficients of zero or more, so no hit lowers a score. Words that report or address are fixed ones and such as the
labels teach.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pa_schema, small_batches

_LETTERS = r"(?<![^\W_])(?:[^\W_][.\-_*·]){2,}[^\W_](?![^\W_])|\w+(?:[!@$*#]+\w+)*"
_WORD, _PLAIN = re.compile(_LETTERS), re.compile(r"\w+")
#: What every text has in which the two patterns differ.
_SIGNED = re.compile(r"[!@$*#](?=\w)|[.\-_*·][^\W_][.\-_*·]")
#: Words, quotation marks (single ones only outside words, where they aren't apostrophes), and the end of a paragraph.
_PARTS = re.compile(_LETTERS + r"|[\"“”„«»]|(?<!\w)[‘‚](?=\w)|(?<=\S)’(?!\w)|\n[^\S\n]*\n")
_SIGNS = str.maketrans("", "", ".-_*·")
#: Fixed lists: quotation marks that open, with those that close them; words that report speech, and that address someone,
#: before any are learned.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’"}
REPORTS = frozenset("said says wrote called quote quoted word term insult sagte schrieb wort zitat nannte dit écrit mot cité appelé dijo escribió palabra cita llamó".split())
ADDRESSES = frozenset("you your yours du dich dir dein tu te toi ton vous votre tú ti usted".split())
#: Words on either side of a hit that make its window; hits of clean texts that tell of a word of context.
WINDOW, PRIOR = 6, 5
STEMS = range(3, 13)


class Lexicon(NamedTuple):
    """Whole words and stems, and for some of these (stems with a star) how many edits they allow at most."""

    words: list[str]
    stems: list[str]
    limits: dict[str, int] = {}


class Context(NamedTuple):
    """Words that report what another says, words that address someone, and words near a term that are none."""

    reports: frozenset = REPORTS
    addresses: frozenset = ADDRESSES
    ordinary: frozenset = frozenset()


class Model(NamedTuple):
    lexicon: Lexicon
    weights: list[float]
    bias: float
    context: Context = Context()


def _edits(term: str, stem: bool) -> int:
    """Edits that a term allows: short terms and short stems only match as they are."""
    return 0 if len(term) < 5 or stem and len(term) < 6 else 1 if len(term) < 8 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie and made deterministic as words come.

    Two neighbouring letters that changed places are one edit: having read the second of a term's next two letters, an
    automaton may wait for the first, as (node after both, first letter).
    """

    #: States kept; when more occur they are dropped and found again.
    MOST = 200_000

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.reach, self.word, self.stem = [0], [-1], [-1]
        for terms, ends, stem in ((lexicon.words, self.word, False), (lexicon.stems, self.stem, True)):
            for t in terms:
                node, k = 0, min(_edits(t, stem), lexicon.limits.get(t + "*" * stem, 9))
                self.reach[0] = max(self.reach[0], k)
                for c in t:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.reach):
                        self.children.append({})
                        for x, v in ((self.reach, 0), (self.word, -1), (self.stem, -1)):
                            x.append(v)
                    self.reach[node] = max(self.reach[node], k)
                ends[node] = k
        self._forget()

    def _forget(self) -> None:
        self.ids: dict = {}
        self.states: list[tuple[dict, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.dead = self._state({}, 9)
        self.start = self._state(self._closed({0: 0}), 9)

    def _closed(self, at: dict) -> dict:
        """With the nodes reached by leaving out letters of terms."""
        todo = [x for x in at.items() if isinstance(x[0], int)]
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < at.get(child, 9):
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return at

    def _state(self, at: dict, stem: int) -> int:
        """stem: the fewest edits of a stem that the word begins with."""
        there = [x for x in at.items() if isinstance(x[0], int)]
        stem = min([stem, *(e for n, e in there if e <= self.stem[n])])
        key = (frozenset(at.items()), stem)
        if key not in self.ids:
            self.ids[key] = len(self.moves)
            self.states.append((at, stem))
            self.moves.append({})
            self.accepts.append(min([stem, *(e for n, e in there if e <= self.word[n])]))
        return self.ids[key]

    def _step(self, at: dict, c: str) -> dict:
        out: dict = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and e < out.get(node, 9):
                out[node] = e

        for node, e in at.items():
            if not isinstance(node, int):
                if node[1] == c:
                    put(node[0], e)
                continue
            put(node, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
                after = self.children[child].get(c)
                if after is not None and letter != c and e + 1 <= self.reach[after]:
                    out[after, letter] = min(e + 1, out.get((after, letter), 9))
        return self._closed(out)

    def edits(self, word: str) -> int:
        """The fewest edits from word to a term, or from its beginning to a stem; 9 where no term is near enough."""
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                if len(self.moves) > self.MOST:
                    self._forget()
                    return self.edits(word)
                at, stem = self.states[state]
                to = self.moves[state][c] = self._state(self._step(at, c), stem)
            state = to
            if state == self.dead:
                return 9
        return self.accepts[state]


FEATURES = ["exact", "near", "addressed", "dense", "quoted", "reported", "weak", "weak_dense"]
#: Added to the edits of hits that are more than their term allows.
WEAK = 10
#: Share of the coefficient of plain hits that quoted and reported ones get where no labelled text has any.
QUOTED = 0.25


def read_words(text: str) -> list[str]:
    """The words of a text in lower case as they stand in it; plain_word() takes signs out."""
    return (_WORD if _SIGNED.search(text) else _PLAIN).findall(text)


def plain_word(word: str) -> str:
    """A word without the signs that part its letters; signs that stand for letters stay."""
    return word if word.isalnum() else word.translate(_SIGNS) if all(len(x) < 2 for x in re.split(r"[.\-_*·]", word)) else word


def quoted_parts(parts: list[str]) -> set[int]:
    """Places between a quotation mark and the next that closes it, within a paragraph."""
    out: set[int] = set()
    opened, closing = -1, ""
    for i, x in enumerate(parts):
        if x[0] == "\n":
            opened = -1
        elif opened >= 0 and x in closing:
            out.update(range(opened + 1, i))
            opened = -1
        elif opened < 0 and x in QUOTES:
            opened, closing = i, QUOTES[x]
    return out


def hits_in(text: str, hits: dict[str, int], context: Context) -> Iterator[tuple[str, int, list[str]]]:
    """Of a text in lower case each hit's kind (quoted, addressed, reported or empty), its edits and its window, which decides by its
    nearest word of context; and last the number of words."""
    parts = _PARTS.findall(text)
    inside = quoted_parts(parts)
    at = [i for i, x in enumerate(parts) if x[0] == "_" or x[0].isalnum()]
    words = [parts[i] for i in at]
    for k, w in enumerate(words):
        if w not in hits:
            continue
        window = [words[j] for d in range(1, WINDOW + 1) for j in (k - d, k + d) if 0 <= j < len(words)]
        kind = "quoted" if at[k] in inside else next(("addressed" if x in context.addresses else "reported" for x in window if x in context.addresses or x in context.reports), "")
        yield kind, hits[w], window
    yield "", len(words), []


def features(text: str, hits: dict[str, int], context: Context = Context()) -> list[float]:
    """Of a text in lower case with some hit, as logarithms: exact hits, misspelled ones by the edits, those of both that address
    someone, all of these in a hundred words, quoted and reported ones, and weak ones, also in a hundred words."""
    *found, (_, n, _) = hits_in(text, hits, context)
    total = dict.fromkeys(FEATURES, 0.0)
    for kind, edits, _ in found:
        strength = 1 / max(1, edits % WEAK)
        if edits >= WEAK:
            total["weak"] += strength
            total["weak_dense"] += 100 * strength / n
            continue
        if kind in ("quoted", "reported"):
            total[kind] += strength
            continue
        total["near" if edits else "exact"] += strength
        total["dense"] += 100 * strength / n
        if kind:
            total[kind] += strength
    return [float(np.log1p(total[c])) for c in FEATURES]


class Reader:
    """Features of texts; keeps the words that hit."""

    def __init__(self, lexicon: Lexicon, context: Context = Context()):
        self.near, self.context = Automaton(lexicon).edits, context
        self.weak = Automaton(lexicon._replace(limits={})).edits if any(k < 2 for k in lexicon.limits.values()) else self.near

    def hits(self, words: set[str]) -> dict[str, int]:
        """The words that are at so many edits from a term, and more by WEAK if no term allows them."""
        found = {w: e for w in words if w not in self.context.ordinary and (e := self.weak(plain_word(w))) < 9}
        return {w: k if (k := self.near(plain_word(w))) < 9 else e + WEAK for w, e in found.items()}

    def features(self, texts: list[str | None]) -> list[list[float]]:
        low = [(t or "").lower() for t in texts]
        words = [set(read_words(t)) for t in low]
        hits = self.hits(set().union(*words))
        return [features(t, hits, self.context) if not hits.keys().isdisjoint(w) else [0.0] * len(FEATURES) for t, w in zip(low, words, strict=True)]


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most about most labelled rows that may be learned from, one of each text.

    Those with crc32(doc_id as text) mod 4 = 2 are held out. The bound picks rows by a hash of the id.
    """
    may = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    share = min(1.0, most / max(1, may.count()))
    may = may.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(may, "doc_id")
    return rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", F.col("toxic").cast("int").alias("toxic"))


def _terms(text: str) -> set[str]:
    """Whole words as they are, stems with a star."""
    words = {plain_word(w) for w in set(read_words(text.lower()))}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def _counted(rows: DataFrame, among: frozenset | None = None, without: frozenset = frozenset()) -> DataFrame:
    """Number of texts of rows with each term, counted in each task first; texts with a term of without don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                terms = _terms(t)
                if without.isdisjoint(terms):
                    n.update(terms if among is None else terms & among)
            if len(n) > 300_000:
                yield pa.RecordBatch.from_pydict({"term": list(n), "n": list(n.values())}, schema=pa_schema("term string, n long"))
                n.clear()
        if n:
            yield pa.RecordBatch.from_pydict({"term": list(n), "n": list(n.values())}, schema=pa_schema("term string, n long"))

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _sources(rows: DataFrame, among: frozenset) -> dict[str, float]:
    """For each of these terms from how many sources rows have it: the exponential of the entropy of the words before it, or of
    those behind it if that is less, so that a group of near copies counts as about one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words = ["", *(plain_word(w) for w in read_words(t.lower())), ""]
                n.update({(x, side, words[k + side]) for k, w in enumerate(words[1:-1], 1) for x in (w, *(w[:i] + "*" for i in STEMS if len(w) >= i)) if x in among for side in (-1, 1)})
        if n:
            term, side, beside = zip(*n, strict=True)
            yield pa.RecordBatch.from_pydict({"term": term, "side": side, "beside": beside, "n": list(n.values())}, schema=pa_schema(schema))

    schema = "term string, side int, beside string, n long"
    n = rows.select("text").mapInArrow(run, schema).groupBy("term", "side", "beside").agg(F.sum("n").alias("n"))
    total = n.groupBy("term", "side").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("own"))
    least = total.groupBy("term").agg(F.min(F.exp(F.log("all") - F.col("own") / F.col("all"))).alias("sources"))
    return {r["term"]: r["sources"] for r in least.collect()}


def learn_lexicon(rows: DataFrame, evidence: float = 30.0, precision: float = 0.8) -> Lexicon:
    """Terms of rows(text, toxic): at least precision of the texts with a term are toxic, and the likelihood ratio
    2 n ln(precision / share of toxic texts) is at least evidence, n being the texts or, if fewer, the term's sources. The terms of several toxic texts come to the driver: rows
    is a bounded sample."""
    toxic, clean = rows.filter("toxic = 1"), rows.filter("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic:
        return Lexicon([], [])
    share = max(n_toxic / (n_toxic + n_clean), 1e-9)
    least = max(3, int(evidence / (2 * max(0.1, np.log(1 / share)))) if share < 1 else 3)
    found = {r["term"]: r["n"] for r in _counted(toxic).filter(F.col("n") >= least).collect()}
    against = {r["term"]: r["n"] for r in _counted(clean, frozenset(found)).collect()}

    def strength(t: str, n: int) -> float:
        p = n / (n + against.get(t, 0))
        return 2 * n * np.log(max(p, share) / share) if p >= precision else 0.0

    good = {t: n for t, n in found.items() if strength(t, n) >= evidence}
    sources = _sources(toxic, frozenset(good)) if good else {}
    good = {t: n for t, n in good.items() if strength(t, n) * min(1.0, sources[t] / n) >= evidence}
    # weaker terms must hold where the strong ones don't explain the label, or near copies of a text would teach its words
    strong = frozenset(t for t, n in good.items() if strength(t, n) >= 3 * evidence)
    if strong and len(strong) < len(good):
        left = {r["term"]: r["n"] for r in _counted(toxic, frozenset(good) - strong, strong).collect()}
        good = {t: n for t, n in good.items() if t in strong or strength(t, left.get(t, 0) or 1) >= evidence}
    stems: list[str] = []
    for t in sorted((t[:-1] for t in good if t[-1] == "*"), key=len):
        if any(t.startswith(s) or s.startswith(t) for s in stems):
            continue
        # the longest stem that nearly as many texts hold
        longer = [u[:-1] for u in good if u[-1] == "*" and u.startswith(t) and good[u] >= 0.98 * good[t + "*"]]
        t = max(longer, key=lambda u: (len(u), u))
        # unless a single whole word makes nearly all of it
        if max((good[w] for w in good if w[-1] != "*" and w.startswith(t)), default=0) < 0.9 * good[t + "*"]:
            stems.append(t)
    known = set(stems)
    words = [w for w in good if w[-1] != "*" and not any(w[:k] in known for k in STEMS)]
    return Lexicon(sorted(words), sorted(stems))


def learn_context(rows: DataFrame, lexicon: Lexicon, share: float = 0.001) -> tuple[Lexicon, Context, list[frozenset]]:
    """The lexicon with limits, beyond which hits are weak, words of context of rows(text, toxic, fold), and for each of the two folds the ordinary words that
    it teaches.

    A word reports if, of the hits with it in their window, e times as many as of all hits are of clean texts, PRIOR at least; it
    addresses if PRIOR or more were to be expected of clean texts and no more than their part of 1 / e are. A fixed word
    stays on its side unless as much evidence is against it. Ordinary are words at some edits from a term that more
    clean than toxic texts hold. A term allows only so many edits that at most that share of the clean texts (one text at least) has
    a word so near to it that the other fold doesn't know as ordinary. All come from the hits of the bounded sample.
    """
    schema = "kind string, word string, fold int, toxic long, clean long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        n: dict[tuple, list[int]] = {}
        for b in batches:
            for t, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                low = t.lower()
                hits = reader.hits(set(read_words(low)))
                seen = [("near", w) for w, e in hits.items() if e]
                if exact := {w: e for w, e in hits.items() if not e}:
                    *found, _ = hits_in(low, exact, Context())
                    seen += [("hit", "")] * len(found) + [("window", w) for kind, _, window in found if kind != "quoted" for w in set(window)]
                for x in seen:
                    n.setdefault((*x, fold), [0, 0])[0 if toxic else 1] += 1
        if n:
            kind, word, fold = zip(*n, strict=True)
            yield pa.RecordBatch.from_pydict({"kind": kind, "word": word, "fold": fold, "toxic": [x[0] for x in n.values()], "clean": [x[1] for x in n.values()]}, schema=pa_schema(schema))

    counts = rows.select("text", "toxic", "fold").mapInArrow(run, schema).groupBy("kind", "word", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    ordinary = [frozenset(r["word"] for r in counts if r["kind"] == "near" and r["fold"] == k and r["clean"] > r["toxic"]) for k in range(2)]
    new: Counter = Counter()  # clean texts by word, as unknown to the other fold
    for r in counts:
        if r["kind"] == "near" and r["word"] not in ordinary[1 - r["fold"]]:
            new[r["word"]] += r["clean"]
    most, limits = max(1.0, share * rows.filter("toxic = 0").count()), {}
    for t in (*lexicon.words, *(x + "*" for x in lexicon.stems)):
        own = Automaton(Lexicon([t], []) if t[-1] != "*" else Lexicon([], [t[:-1]]))
        apart: Counter = Counter()
        for w, n in new.items():
            apart[own.edits(plain_word(w))] += n
        limits[t] = next((k - 1 for k in (1, 2) if sum(n for e, n in apart.items() if e <= k) > most), 2)
    clean = sum(r["clean"] for r in counts if r["kind"] == "hit") / max(1, sum(r["clean"] + r["toxic"] for r in counts if r["kind"] == "hit"))
    windows: Counter = Counter()
    free: Counter = Counter()
    for r in counts:
        if r["kind"] == "window":
            windows[r["word"]] += r["clean"] + r["toxic"]
            free[r["word"]] += r["clean"]
    reports = {w for w, n in free.items() if n >= PRIOR and n >= np.e * clean * windows[w]}
    addresses = {w for w, n in windows.items() if clean * n >= PRIOR and free[w] <= clean * n / np.e}
    reports |= {w for w in REPORTS if clean * windows[w] < PRIOR or free[w] > clean * windows[w]}
    addresses |= {w for w in ADDRESSES if free[w] < PRIOR or free[w] < clean * windows[w]}
    return lexicon._replace(limits=limits), Context(frozenset(reports - addresses), frozenset(addresses - reports), ordinary[0] | ordinary[1]), ordinary


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """Lexicon, context and regression from at most about most labelled rows; without toxic rows every text scores near 0.

    That bound also bounds what comes to the driver. For the regression a text's ordinary words are those that the other half of the
    sample teaches, and each toxic text with hits counts twice more: as if all of them were misspelled, and as if one word were that
    alone is a hit.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Matrices

    small_batches(docs.sparkSession, 512)
    rows = labelled(docs, labels, most).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).persist()
    try:
        lexicon = learn_lexicon(rows)
        kinds = rows.groupBy("toxic").count().count()
        if kinds < 2 or not (lexicon.words or lexicon.stems):
            positive = rows.filter("toxic = 1").count() / max(1, rows.count())
            p = min(max(positive, 1e-3), 1 - 1e-3)
            return Model(lexicon, [0.0] * len(FEATURES), float(np.log(p / (1 - p))))
        lexicon, context, ordinary = learn_context(rows, lexicon)
        schema = "toxic int, " + ", ".join(f"{c} double" for c in FEATURES)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers = [Reader(lexicon, context._replace(ordinary=ordinary[1 - k])) for k in range(2)]
            for b in batches:
                out = []
                for t, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                    low = t.lower()
                    hits = readers[fold].hits(set(read_words(low)))
                    out.append((toxic, *features(low, hits, context)))
                    if toxic and (hits := {w: e for w, e in hits.items() if e < WEAK}):
                        out += [(toxic, *features(low, dict.fromkeys(x, 1), context)) for x in (hits, [min(hits)])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=pa_schema(schema))

        seen = rows.mapInArrow(run, schema).persist()
        found = LogisticRegression(regParam=1e-4, maxIter=100, lowerBoundsOnCoefficients=Matrices.dense(1, len(FEATURES), [0.0] * len(FEATURES))).fit(
            seen.select(F.col("toxic").cast("double").alias("label"), array_to_vector(F.array(*(F.col(c) for c in FEATURES))).alias("features"))
        )
        weights = dict(zip(FEATURES, map(float, found.coefficients), strict=True))
        seen_of = seen.agg(*(F.max(c).alias(c) for c in FEATURES)).first()
        seen.unpersist()
        weights |= {c: QUOTED * weights["exact"] for c in ("quoted", "reported") if not seen_of[c]}
        return Model(lexicon, list(weights.values()), float(found.intercept), context)
    finally:
        rows.unpersist()


def _with_features(rows: DataFrame, model: Model, keep: str) -> DataFrame:
    """rows(text, ...) to the columns of keep and the features."""
    names = [x.split()[0] for x in keep.split(", ")]

    def make():
        reader = Reader(model.lexicon, model.context)

        def f(b: pa.RecordBatch) -> dict:
            x = np.array(reader.features(b.column("text").to_pylist())).reshape(-1, len(FEATURES))
            return {c: b.column(c) for c in names} | {c: x[:, i] for i, c in enumerate(FEATURES)}

        return f

    return map_batches(rows.select("text", *names), make, keep + "".join(f", {c} double" for c in FEATURES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.3 on).

    Only the text counts. A null or empty text has no hits and scores as any text without hits; a null doc_id isn't held
    out. Repeated rows score alike; an empty table gives no row.
    """
    small_batches(docs.sparkSession, 512)
    seen = _with_features(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")), model, "doc_id long")
    logit = F.lit(model.bias)
    for c, w in zip(FEATURES, model.weights, strict=True):
        logit = logit + F.lit(w) * F.col(c)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    out = seen.select("doc_id", held.alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """score() by a model that is fitted to the labels first."""
    return score(docs, fit(docs, labels, most))


def keep_civil(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The documents that aren't predicted toxic, with all columns, whatever their names.

    Only the text counts, whole; null and empty texts have no hits and stay unless most labelled texts are toxic. Rows
    without a doc_id are judged like others; repeated rows stay or go together. Empty tables give none, and without
    labels all stay.
    """
    model = fit(docs, labels, most)
    small_batches(docs.sparkSession, 512)
    weights, bias = np.array(model.weights), model.bias
    readers: dict[str, Reader] = {}

    @F.pandas_udf("boolean")
    def civil(text):
        import pandas as pd

        if "own" not in readers:
            readers["own"] = Reader(model.lexicon, model.context)
        x = np.array(readers["own"].features(text.tolist())).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-(x @ weights + bias))) < 0.3)

    return docs.filter(civil("text"))
