"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is a sequence of words and tags in page order. Plain words score positive; tags, words of links and words inside
boilerplate elements score negative. The weights are log-likelihood ratios of the classes inside and outside the content
element of labelled pages: those that mark their content with one article or main element. One linear scan finds the
contiguous run of the highest score: the content region. It grows to whole blocks, and on to the end of the element that
holds it. Boilerplate elements inside it are left out of the text: navigation, forms and the like, and elements for which
the evidence of their names and of their text together is negative: parts of class, id and role names speak for or against
them, by fixed and by learned weights, and so do long blocks of plain words, links, and a run of children of one kind, as
threads of comments have them. No name alone outweighs prose under a name that says something else, too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pa_schema, small_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z",
    re.S,
)
#: Elements whose inside is no text, with their ends; of those in TO_END all that follows is inside where no end comes.
RAW = {t: re.compile(f"</{t}\\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "template", "title", "svg", "iframe")}
TO_END = frozenset(("script", "style", "textarea", "title"))
#: A tag that closes itself: a slash that isn't part of a value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_HINTS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Fixed lists: elements that break text into blocks, that are never content, and whose nesting is followed.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form head button select option fieldset menu dialog".split())
NESTED = NEVER | frozenset("header article main section div ul ol dl table a p".split())
#: Blocks that may stand in a paragraph; all others end it.
IN_PARAGRAPH = frozenset("br button caption legend option select".split())
#: Fixed lists: parts of class, id and role names that mark boilerplate, surely or as a rule; and parts that say nothing.
SURE = frozenset("ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent disqus masthead nav navbar newsletter sidebar sponsor sponsored subscribe".split())
RULE = frozenset("banner cookie cookies discussion discussions feedback footer header menu modal navigation notice notification popup promo promoted reactions related reply replies respond responses search share sharing social toolbar widget".split())
NEUTRAL = frozenset("area bar block bottom box button buttons col column container content data el elem first form group id inner item items last layout left line link links list main middle outer page panel post posts article articles right row section slot small story stories text thread title top unit wrap wrapper".split())
#: Evidence in the units of the learned weights: such parts before any are learned; an unknown part inside the content; prose, half of
#: the page's words or more under a first heading, a section element, mostly links, and children of one kind.
SURELY, AS_A_RULE, UNKNOWN, PROSE, BULK, SECTION, LINKS, THREAD = -8.0, -4.0, 4.0, 3.0, 6.0, 2.0, -2.0, -4.0
#: Classes of words; weights where no page is labelled.
PLAIN, LINKED, OUTSIDE, TAG, PART = "word", "word:link", "word:boilerplate", "tag:", "part:"
DEFAULT = {PLAIN: 1.0, LINKED: -0.5, OUTSIDE: -0.5, TAG: -0.2}
CONTENT = ("article", "main")


def _names(attributes: str) -> list[list[str]]:
    """The class, id and role names of a tag, each in its parts."""
    if "=" not in attributes:
        return []
    names = (n for m in _HINTS.finditer(attributes) for n in m[1].strip("\"'").split())
    return [p for n in names if (p := re.findall(r"[a-z]{2,}|^[a-z]$", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower()))]


def _part(part: str, weights: dict[str, float]) -> float:
    return (SURELY if part in SURE else AS_A_RULE if part in RULE else 0.0) + weights.get(PART + part, 0.0)


class Item(NamedTuple):
    """A piece of text or a tag: its class, text (" " for a tag that breaks blocks), whether it stands in the content
    element, the innermost element that is followed, and how many words it counts as."""

    kind: str
    text: str
    content: bool
    element: int
    words: int


class Element(NamedTuple):
    """An element that is followed: its parent, name, first item, the item after its last, how many stand around it, the
    parts of its names, those of them that no element around it has, and whether it stands in the content element."""

    parent: int
    name: str
    first: int
    last: int
    depth: int
    names: list[list[str]]
    new: frozenset
    content: bool


class Page(NamedTuple):
    items: list[Item]
    elements: list[Element]


def read_page(page: str, weights: dict[str, float]) -> Page:
    """Items and followed elements in page order, in time that grows with the page alone, however deep it is."""
    items: list[Item] = []
    elements: list[Element] = [Element(-1, "", 0, 0, 0, [], frozenset(), False)]
    open_ = [0]
    around: Counter = Counter()  # open elements by name, and by part of names
    links = 0

    def put(kind: str, text: str, words: int) -> None:
        items.append(Item(kind, text, around["article"] + around["main"] > 0, open_[-1], words))

    def read(text: str) -> None:
        put(LINKED if links else PLAIN, text, len(text.split()))

    def close() -> str:
        nonlocal links
        e = open_.pop()
        elements[e] = own = elements[e]._replace(last=len(items))
        around[own.name] -= 1
        around.subtract(PART + p for p in own.new)
        links -= own.name == "a"
        return own.name

    at = 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            read(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in RAW and not closing:
            end = None if name == "svg" and _CLOSED.search(attributes) or around["/" + name] else RAW[name].search(page, at)
            if end:
                at = end.end()
            elif name in TO_END and not around["/" + name]:
                break
            elif not _CLOSED.search(attributes) or name != "svg":
                around["/" + name] = 1  # no end follows from here on
            continue
        if not closing and name in BLOCKS and name not in IN_PARAGRAPH and elements[open_[-1]].name == "p":
            close()
        blank = " " if name in BLOCKS else ""
        if closing:
            put(TAG + name, blank, 1)
            if name in NESTED and around[name] > 0:
                while close() != name:
                    pass
            continue
        if name == "a" and elements[open_[-1]].name == "a":
            close()
        put(TAG + name, blank, 1)
        if name in NESTED and not _CLOSED.search(attributes):
            names = _names(attributes)
            new = frozenset(p for parts in names for p in parts if around[PART + p] < 1)
            up = open_[-1]
            elements.append(Element(up, name, len(items), 0, elements[up].depth + 1, names, new, around["article"] + around["main"] > 0))
            open_.append(len(elements) - 1)
            around[name] += 1
            around.update(PART + p for p in new)
            links += name == "a"
    else:
        if at < len(page):
            read(page[at:])
    while open_:
        close()
    bad = _boilerplate(items, elements, weights)
    return Page([x._replace(kind=OUTSIDE) if bad[x.element] and not x.kind.startswith(TAG) else x for x in items], elements)


def _part(part: str, weights: dict[str, float]) -> float:
    return (SURELY if part in SURE else AS_A_RULE if part in RULE else 0.0) + weights.get(PART + part, 0.0)


def _boilerplate(items: list[Item], elements: list[Element], weights: dict[str, float]) -> list[bool]:
    """For each element whether it or one around it is boilerplate."""
    plain, linked, blocks, heads = [0], [0], [0], [0]
    fresh = True
    for x in items:
        tag = x.kind.startswith(TAG)
        fresh = fresh or _breaks(x)
        plain.append(plain[-1] + (x.words if x.kind == PLAIN else 0))
        linked.append(linked[-1] + (x.words if x.kind == LINKED else 0))
        blocks.append(blocks[-1] + (fresh and not tag and x.words > 0))
        fresh = fresh and (tag or not x.words)
        heads.append(heads[-1] + (x.kind == TAG + "h1"))
    kinds: dict[tuple, list[int]] = {}  # of children of one kind: how many, and their words
    for e in elements[1:]:
        if e.names:
            kind = kinds.setdefault((e.parent, e.name, *map(tuple, e.names)), [0, 0])
            kind[0] += 1
            kind[1] += plain[e.last] - plain[e.first]
    threads = {k[0] for k, (n, words) in kinds.items() if n > 1 and 2 * words > plain[elements[k[0]].last] - plain[elements[k[0]].first]}

    def marked(k: int, e: Element) -> bool:
        own, links = plain[e.last] - plain[e.first], linked[e.last] - linked[e.first]
        if e.name == "form":  # some pages stand in one form as a whole
            return 2 * own < plain[-1]
        if e.name in NEVER or e.name == "header" and not e.content:
            return True
        if e.name in CONTENT or not e.names:
            return False
        text = PROSE if own >= 20 and own >= 3 * links and own >= 8 * (blocks[e.last] - blocks[e.first]) else LINKS if links > own else 0.0
        text += BULK if 2 * own >= plain[-1] and heads[e.last] > heads[e.first] else 0.0
        text += (SECTION if e.name == "section" else 0.0) + (THREAD if k in threads else 0.0)
        for parts in e.names:
            name = [_part(p, weights) for p in parts]
            other = sum(UNKNOWN for p, w in zip(parts, name, strict=True) if not w and len(p) > 1 and p not in NEUTRAL) if e.content else 0.0
            if min(name) <= -2 and sum(name) + other + text < 0:
                return True
        return False

    bad = [False]
    for k, e in enumerate(elements[1:], 1):
        bad.append(bad[e.parent] or marked(k, e))
    return bad


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """Start and end of the contiguous run of the highest positive sum; of several the first, and its shortest. (0, 0) if
    nothing scores positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores.tolist()):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def _breaks(x: Item) -> bool:
    return x.text == " " and x.kind.startswith(TAG)


def whole_blocks(page: Page, a: int, b: int) -> tuple[int, int]:
    """The region, grown to whole blocks and then over the blocks beside it in the element that holds it: over all of an
    article or main element, in others up to the first list of links; never over the page itself."""
    items, elements = page
    while a and not _breaks(items[a - 1]):
        a -= 1
    while b < len(items) and not _breaks(items[b]):
        b += 1
    e = min((items[i].element for i in range(a, b)), key=lambda e: elements[e].depth)
    up = e
    while up and elements[up].name not in CONTENT:
        up = elements[up].parent
    if up:
        return min(a, elements[up].first), max(b, elements[up].last)
    while e and elements[e].name in ("a", "p"):
        e = elements[e].parent
    if e:
        first, last = elements[e].first, elements[e].last
        b = max([b, *_without_lists(items, range(b, last))])
        a = min([a, *(i + 1 for i in _without_lists(items, range(a - 1, first - 1, -1)))]) if a > first else a
        a = max(a, first)
    return a, b


def _without_lists(items: list[Item], order: range) -> Iterator[int]:
    """In that order the places of items that break blocks, and the place after the last, up to the first list of links: blocks of
    mostly links, with no other block between them, that have two links or under four words."""
    words: Counter = Counter()
    links = listed = listed_words = 0
    held: list[int] = []
    for i in [*order, order.stop]:
        if i != order.stop and not _breaks(items[i]):
            words[items[i].kind] += items[i].words
            links += items[i].kind == LINKED and items[i].words > 0
            continue
        held.append(i)
        if words[LINKED] > words[PLAIN]:
            listed, listed_words = listed + links, listed_words + words[LINKED]
            if listed > 1:
                return
        elif words[PLAIN]:
            if listed and listed_words < 4:
                return
            yield from held
            held.clear()
            listed = listed_words = 0
        words.clear()
        links = 0
    if not listed or listed_words >= 4:
        yield from held


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the content region; empty for a null or empty page or one without positive words."""
    read = read_page(page or "", weights)
    tag = weights.get(TAG, DEFAULT[TAG])
    scores = np.array([weights.get(x.kind, tag) * x.words for x in read.items])
    a, b = best_region(scores)
    if a < b:
        a, b = whole_blocks(read, a, b)
    return " ".join(entities.unescape("".join([x.text for x in read.items[a:b] if x.kind != OUTSIDE])).split())


def learn_weights(pages: DataFrame, most: int = 2000, least: int = 50) -> dict[str, float]:
    """Weights from at most about most pages with exactly one article or main element (picked by a hash of their html).

    The weight of a class is the logarithm of its share inside the content over its share outside, within 8 of zero;
    plain words are at least 0.1 and tags at most -0.1. Words in boilerplate lie between -1 and -0.1: they are left out of
    the text in any case, and an advert must not part an article. The weight of a part of names is the change that it
    makes to the odds of a word to be content, drawn towards none by least words; parts over fewer words have none.
    """
    opened = lambda t: F.size(F.split(F.lower("html"), f"<{t}[\\s>]")) - 1
    marked = pages.filter(F.col("html").isNotNull()).filter(opened("article") + opened("main") == 1)
    share = min(1.0, most / max(1, marked.count()))
    rows = marked.select("html").filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < share * (1 << 20))
    schema = "class string, inside long, outside long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter = Counter()
        outside: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                read = read_page(page, {})
                words = {True: [0], False: [0]}
                for x in read.items:
                    (inside if x.content else outside)[x.kind] += x.words
                    for content, n in words.items():
                        n.append(n[-1] + (0 if x.kind.startswith(TAG) or x.content != content else x.words))
                for e in read.elements:
                    for p in e.new:
                        inside[PART + p] += words[True][e.last] - words[True][e.first]
                        outside[PART + p] += words[False][e.last] - words[False][e.first]
        kinds = sorted({*inside, *outside})
        if kinds:
            yield pa.RecordBatch.from_pydict({"class": kinds, "inside": [inside[k] for k in kinds], "outside": [outside[k] for k in kinds]}, schema=pa_schema(schema))

    known = [*DEFAULT, *(TAG + x for x in sorted(BLOCKS | NESTED | {"b", "i", "em", "strong", "span", "img", "code", "sup", "sub", "small", "u"}))]
    small_batches(pages.sparkSession, 512)
    counts = rows.mapInArrow(run, schema).groupBy("class").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    found = counts.filter(F.col("class").isin(known) | F.col("class").startswith(PART) & (F.col("inside") + F.col("outside") >= least)).collect()
    parts, found = [r for r in found if r["class"].startswith(PART)], [r for r in found if not r["class"].startswith(PART)]
    weights = dict(DEFAULT)
    if not found:
        return weights
    total_in, total_out = (sum(r[c] for r in found) + len(found) for c in ("inside", "outside"))
    for r in found:
        w = float(np.clip(np.log((r["inside"] + 1) / total_in) - np.log((r["outside"] + 1) / total_out), -8, 8))
        kind = r["class"]
        weights[kind] = max(w, 0.1) if kind == PLAIN else min(w, -0.1) if kind.startswith(TAG) else float(np.clip(w, -1.0, -0.1)) if kind == OUTSIDE else w
    words = [sum(r[c] for r in found if not r["class"].startswith(TAG)) + 1 for c in ("inside", "outside")]
    base = words[0] / sum(words)
    for r in parts:
        odds = (r["inside"] + least * base) / (r["outside"] + least * (1 - base))
        weights[r["class"]] = float(np.clip(np.log(odds) - np.log(base / (1 - base)), -6, 6))
    return weights


def extract(pages: DataFrame, most: int = 2000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Character references are decoded, white space becomes single spaces, and blocks are joined by one. A null or empty
    html has an empty text. Null and repeated page_ids keep a row each; an empty table gives none.
    """
    weights = learn_weights(pages, most)
    small_batches(pages.sparkSession, 512)

    def make():
        def f(b: pa.RecordBatch) -> dict:
            texts = [main_text(h, weights) for h in b.column("html").to_pylist()]
            return {"page_id": b.column("page_id"), "url": b.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return f

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), make, "page_id long, url string, text string, n_chars long")
