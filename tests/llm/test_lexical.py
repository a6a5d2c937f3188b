import math
import random
import re

from strandsieve.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, item_id long, score string, rank int, bag string, m int"


def words(t):
    return TERM.findall((t or "").translate(A_TO_Z))


def plain(docs, items, most=50):
    bags = [(i, words(t)) for i, t in docs]
    bags = [(i, w) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    sought = {}
    for i, t in items:
        sought.setdefault(i, set()).update(words(t))
    out = []
    for item, own in sought.items():
        found = []
        for doc, w in bags:
            m, score = 50 + 50 * len(w) * n_docs // n_terms, 0
            for t in own & set(w):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m))
            if score > 0:
                found.append((-score, 2**63 - 1 if doc is None else doc, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda x: x[:2])[:most])]
    return sorted(out, key=str)


def ours(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, "s", 2, "b", 3) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 7, "t") for i, t in items], "item_id long, text string, doc_id long, term string").repartition(2)
    return sorted(map(tuple, lexical.ranked_search(d, b, **how).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def odd_tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "été", "naïve", "日本語", "x1", "1", "don't", " "]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " -- !? \t\n"), (None, "w1 w2 w3"), (None, None)]
    docs += [(300 + i, "W1 w2, w2.w7@w9") for i in range(120)]  # a third have one bag
    docs += [(500, "w3 " * 50_000 + "w4"), (501, "same same"), (501, "same same"), (502, "same_same")]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "!!"), (23, "nothing holds this-or-that-zz"), (24, "same"), (24, "w2"), (None, "w1 W1 1"), (25, "w2 w7"), (25, "w2 w7")]
    return docs, items


def test_equals_plain_scores(spark):
    docs, items = odd_tables()
    want = plain(docs, items)
    assert ours(spark, docs, items) == want
    assert ours(spark, docs, items, pass_bytes=200) == want  # several passes
    assert ours(spark, docs, items, most=3) == plain(docs, items, 3)


def test_equal_scores_go_by_doc_id_over_classes(spark):
    # the first two bags differ in their terms and score alike for both items
    docs = [(i, ["aa zz", "bb zz", "zz cc"][i % 3]) for i in range(90)]
    items = [(1, "aa bb"), (2, "zz")]
    assert ours(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])):
        assert ours(spark, docs, items) == []
