import math
import random
import re
import zlib

from strandsieve.llm import toxicity

from .fixtures import documents


def distance(a, b):
    """Edits, two neighbouring letters that changed places being one, none of them edited twice."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_the_edit_distance():
    r = random.Random(7)
    lex = toxicity.Lexicon(["stupid", "loser", "worthless", "abc"], ["lowei", "chonfa"])
    a = toxicity.Automaton(lex)
    for _ in range(5000):
        w = list(r.choice([*lex.words, *lex.stems]))
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            k = r.randint(0, 3)
            if k == 0:
                w.insert(i, r.choice("abclostu"))
            elif k == 3:
                w[i : i + 2] = reversed(w[i : i + 2])
            elif i < len(w):
                w[i : i + 1] = [r.choice("abclostu")] if k == 1 else []
        w = "".join(w) + r.choice(["", "en"])
        near = [e for t in lex.words if (e := distance(t, w)) <= toxicity._edits(t, False)]
        near += [e for t in lex.stems for k in range(len(w) + 1) if (e := distance(t, w[:k])) <= toxicity._edits(t, True)]
        assert a.edits(w) == min([*near, 9])


#: Coefficients by which the tests weigh features: those of a model in small.
COEFFICIENTS = {"exact": 1.0, "near": 0.8, "addressed": 0.5, "dense": 0.0, "quoted": 0.2, "reported": 0.3, "weak": 0.1, "weak_dense": 0.0}


def weighed(text, hits):
    return sum(COEFFICIENTS[c] * x for c, x in zip(toxicity.FEATURES, toxicity.features(text, hits), strict=True))


def test_quoted_hits_count_less_than_addressed_ones():
    hits = {"idiot": 0}
    plain, quoted, direct = (weighed(t, hits) for t in ("an idiot is there", 'the word "idiot" is old', "you idiot there"))
    assert quoted < plain < direct


def test_the_nearest_word_of_context_decides():
    hits = {"idiot": 0}
    assert weighed("he said you are an idiot", hits) == weighed("you idiot", hits)
    assert weighed("you heard that he said idiot", hits) == weighed("he said idiot", hits) < weighed("idiot", hits)


def test_apostrophes_open_no_quotation():
    hits = {"idiot": 0}
    exact = lambda t: weighed(t, hits)
    assert exact("i don’t like that idiot and he’s bad") == exact("i do like that idiot and he is bad") == exact("the dogs’ idiot isn't theirs’")
    assert exact("she heard ‘what an idiot’ there") < exact("she heard what an idiot there") == exact("“one” idiot “two”") == exact("a “mark \n\n idiot there” it") == exact('5" idiot')
    far = "x " * 60
    assert exact(f"«{far} idiot {far}»") == exact(f"„{far} idiot {far}“") < exact(f"{far} idiot {far}")


def test_signs_for_letters_and_between_them():
    reader = toxicity.Reader(toxicity.Lexicon(["idiot"], []))
    plain, parted, sign, none = (reader.features([t])[0] for t in ("that idiot there", "that i.d.i.o.t there", "that id!ot there", "that i.d. there"))
    assert parted == plain and sign[:2] == [0.0, plain[0]] and none == [0.0] * len(toxicity.FEATURES)


def plain_features(text, words, stems, limits):
    """Edit distances to each term, and a hit's context looked at word by word."""
    text = (text or "").lower()
    spans = [m.span() for m in re.finditer(r'"[^"]*"|“[^”]*”', text)]
    found = list(re.finditer(r"\w+", text))
    total = dict.fromkeys(toxicity.FEATURES, 0.0)
    for i, m in enumerate(found):
        w = m[0]
        edits = [(e, limits.get(t, 9)) for t in words if (e := distance(t, w)) <= toxicity._edits(t, False)]
        edits += [(e, limits.get(t + "*", 9)) for t in stems for k in range(len(w) + 1) if (e := distance(t, w[:k])) <= toxicity._edits(t, True)]
        if not edits:
            continue
        strict = [e for e, most in edits if e <= most]
        strength = 1 / max(1, min(strict or [e for e, _ in edits]))
        if not strict:
            total["weak"] += strength
            total["weak_dense"] += 100 * strength / len(found)
            continue
        kind = "quoted" if any(a < m.start() < b for a, b in spans) else ""
        for d in range(1, 7):
            for j in (i - d, i + d):
                if not kind and 0 <= j < len(found):
                    kind = "addressed" if found[j][0] in toxicity.ADDRESSES else "reported" if found[j][0] in toxicity.REPORTS else ""
        if kind in ("quoted", "reported"):
            total[kind] += strength
            continue
        total["near" if min(strict) else "exact"] += strength
        total["dense"] += 100 * strength / len(found)
        if kind:
            total[kind] += strength
    return [math.log1p(total[c]) for c in toxicity.FEATURES]


def test_scores_are_those_of_plain_features(spark):
    lexicon = toxicity.Lexicon(["stupid", "loser", "worthless"], ["loweis"], {"loser": 0, "worthless": 1})
    model = toxicity.Model(lexicon, [1.5, 0.7, 0.3, 0.4, 0.2, 0.1, 0.6, 0.5], -3.0)
    r = random.Random(5)
    near = ["stupid", "stupd", "losers", "worthles", "worthlsse", "loweist", "loewis", "loweis", "lowex", "lose", "lsoer", "worthlesss"]
    other = [f"w{i}" for i in range(40)] + ["you", "wort"]
    rows = []
    for i in range(150):
        t = [r.choice(near) if r.random() < 0.1 else r.choice(other) if r.random() < 0.97 else "said" for _ in range(r.randint(0, 60))]
        if len(t) > 20 and i % 3 == 0:
            a = r.randint(7, 12)
            t[a], t[a + r.randint(0, 6)] = '"' + t[a], t[a] + '"'
        rows.append((i, " ".join(t)))
    rows += [(1000, None), (1001, ""), (None, "you stupid loser"), (1002, "stupid " * 5000), (1003, "same loser"), (1003, "same loser"), (1004, "x" * 3000)]
    got = sorted((str(x.doc_id), round(x.score, 9), x.predicted) for x in toxicity.score(documents(spark, rows), model).collect())
    want = []
    for i, t in rows:
        s = 1 / (1 + math.exp(-(model.bias + sum(w * x for w, x in zip(model.weights, plain_features(t, *lexicon), strict=True)))))
        want.append((str(i), round(s, 9), int(s >= 0.3)))
    assert got == sorted(want)


def _labelled(spark):
    r = random.Random(3)
    words = [f"tok{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        t = [r.choice(words) for _ in range(30)]
        toxic = i % 8 == 0
        if toxic:
            t[5] = ["wretchy", "gronk" + r.choice(["s", "ly", "est", "ing", "ed", "en", "or", "al"])][i // 8 % 2]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    return documents(spark, [*rows, (1000, None), (1001, ""), (None, "wretchy gronked"), (1002, "a wretcby person")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark):
    docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    held = [(r.predicted, int(i % 8 == 0)) for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].predicted == got[1001].predicted == 0 and got[None].predicted == 1
    model = toxicity.fit(docs, labels)
    assert model.lexicon.stems == ["gronk"] and "wretchy" in model.lexicon.words


def test_stage_and_empty_tables(spark):
    docs, labels = _labelled(spark)
    kept = {r.doc_id for r in toxicity.keep_civil(docs, labels).collect()}
    assert kept & set(range(400)) == {i for i in range(400) if i % 8} and {1000, 1001} <= kept
    assert toxicity.toxicity(documents(spark, []), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def misspelled(word, kind, r):
    i = r.randint(1, len(word) - 3)
    return [word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i + 1 :], word[:i] + "q" + word[i:], word[:i] + "q" + word[i + 1 :]][kind]


def test_one_misspelled_term_in_a_clean_text_is_found(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels)
    assert min(model.weights) >= 0
    r = random.Random(9)
    rows = []
    for i in range(200):
        t = [f"tok{r.randrange(300)}" for _ in range([10, 60, 1000][i % 3])]
        t[r.randrange(len(t))] = misspelled("wretchy", i % 4, r)
        rows.append((i, " ".join(t)))
    clean = [(1000 + i, " ".join(t for t in text.split() if t[:3] == "tok")) for i, text in rows]
    got = {x.doc_id: x.predicted for x in toxicity.score(documents(spark, rows + clean), model).collect()}
    assert sum(got[i] for i in range(200)) >= 0.98 * 200 and not any(got[1000 + i] for i in range(200))


def test_ordinary_words_near_a_term_are_no_hits(spark):
    r = random.Random(4)
    rows = []
    for i in range(600):
        t = [f"tok{r.randrange(300)}" for _ in range(30)]
        t[3] = ["wretchy", "wretchd"][i % 6 > 0]  # a clean word at one edit from the term
        rows.append((i, " ".join(t)))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, rows), labels)
    assert model.lexicon.words == ["wretchy"] and "wretchd" in model.context.ordinary
    got = {x.doc_id: x.predicted for x in toxicity.score(documents(spark, [(1, "that wretchd tok1"), (2, "that wretcyh tok1"), (3, "that wretchy tok1")]), model).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_words_of_near_copies_are_no_terms(spark):
    r = random.Random(6)
    base = ["".join(r.choices("abcdefghijklmnopq", k=7)) for _ in range(40)]
    rows, labels = [], []
    for i in range(600):
        t = [f"tok{r.randrange(300)}" for _ in range(40)]
        if i % 6 == 0:
            t = list(base) if i % 12 == 0 else t
            t[r.randrange(40)] = "wretchy"
        rows.append((i, " ".join([*t, f"tok{i}"])))
        labels.append((i, 1, int(i % 6 == 0)))
    found = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).lexicon
    assert found.words == ["wretchy"] and not found.stems


def test_context_is_learned(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        t = [f"tok{r.randrange(300)}" for _ in range(30)]
        if i % 8 == 0:
            t[10] = "wretchy"
        elif i % 40 == 1:
            t[10:12] = ["zaggt", "wretchy"]  # clean texts that report it by a word of no list
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 8 == 0)))
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert "zaggt" in model.context.reports and toxicity.REPORTS <= model.context.reports
    got = {x.doc_id: x.predicted for x in toxicity.score(documents(spark, [(1, "tok1 zaggt wretchy"), (2, "tok1 wretchy"), (3, 'then "wretchy" it was')]), model).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
