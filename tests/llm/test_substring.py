import hashlib
import re

import pytest

from strandsieve.llm import substring

from .fixtures import documents, texts

LAST = 2**63 - 1


def brute(rows, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    order = [LAST if i is None else i for i, _ in rows]
    low = {}
    for ws, d in zip(words, order, strict=True):
        for j in range(len(ws) - window + 1):
            k = tuple(ws[j : j + window])
            low[k] = min(low.get(k, LAST), d)
    out = []
    for (i, _), ws, d in zip(rows, words, order, strict=True):
        keep = [True] * len(ws)
        for j in range(len(ws) - window + 1):
            if low[tuple(ws[j : j + window])] < d:
                keep[j : j + window] = [False] * window
        kept = [w for w, k in zip(ws, keep, strict=True) if k]
        out.append((str(i), len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "run", "part"), [(50, 12, 2000), (50, 12, 4), (6, 2, 3)])
def test_equals_brute_force(spark, window, run, part):
    got = substring.substring_dedup(documents(spark), window, run, part).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(texts(), window)


def test_stage_cuts_the_same_words_and_keeps_rows(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.n_chars): r.text for r in substring.without_repeats(docs).filter("doc_id >= 200 AND doc_id < 243").collect()}
    assert got[200, len(got[200, max(n for i, n in got if i == 200)])].startswith("start 0 word0")
    assert {t for (i, _), t in got.items() if 201 <= i <= 229} == {f"start {i} {i}" for i in range(1, 30)}  # "word69 end" repeats as well
    assert substring.without_repeats(docs).columns == docs.columns
    assert substring.without_repeats(docs).count() == docs.count()


def test_empty_table(spark):
    assert substring.substring_dedup(documents(spark, [])).count() == 0
