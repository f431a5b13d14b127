import random

import pytest

from transloom.llm.leakage import find_leaks, needed_score, plain_words

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, passage string, doc_id string"
rng = random.Random(11)
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "ve", "na") for b in ("ber", "don", "fel", "gard", "lin", "mot", "sen", "tis", "wick", "zar")]


def passage(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_words_ignore_form():
    assert plain_words("<p>Caf&eacute; «Straße», diff-\nerent (Hear, hear!) No. 12</p>") == [b"cafe", b"strasse", b"different", b"no", b"12"]
    assert plain_words(None) == [] and plain_words("") == [] and plain_words("日本") != []


def noisy(text, rate):
    out = []
    for w in text.split():
        x = rng.random()
        if x < rate / 2:
            continue
        out.append(w[:-1] + "q" if x < rate else w)
        if rng.random() < 0.05:
            out.append("[Interruption.]")
    return " ".join(out).upper().replace(" ", "\n", 3)


@pytest.fixture(scope="module")
def corpus():
    items = [(i, passage(50 + 4 * i), "x") for i in range(12)]
    docs, want = [], set()
    for d in range(150):
        text, own = passage(rng.randrange(0, 300)), rng.randrange(12)
        words = items[own][1].split()
        kind = d % 5
        if kind == 0:
            text += " " + noisy(items[own][1], 0.08) + " " + passage(30)
            want.add((own, 1000 + d))
        elif kind == 1:
            at = rng.randrange(0, len(words) // 2)
            text += " " + " ".join(words[at : at + len(words) // 2]) + " " + passage(40)
            want.add((own, 1000 + d))
        elif kind == 2:
            shuffled = words[:]
            rng.shuffle(shuffled)
            text += " " + " ".join(shuffled)
        elif kind == 3:
            text += " " + " ".join(words[:9]) + " " + passage(20) + " " + " ".join(words[20:29])
        docs.append((1000 + d, text, "y"))
    return docs, items, want


def test_planted_passages(spark, corpus):
    docs, items, want = corpus
    for size in (100_000, 300):
        rows = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), pass_words=size).collect()
        got = {(r.item_id, r.doc_id) for r in rows}
        assert len(rows) == len(got) and got == want


def brute_score(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (1 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def test_recall_against_brute_force_alignment(spark, corpus):
    docs, items, _ = corpus
    want = {(i, d) for i, p, _ in items for d, t, _ in docs if brute_score(plain_words(p), plain_words(t)) >= needed_score(len(plain_words(p)))}
    got = {(r.item_id, r.doc_id) for r in find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_nulls_long_texts_repeats_and_empty_tables(spark):
    long = passage(60)
    docs = [(1, None, ""), (2, "", ""), (None, long, ""), (3, passage(200_000) + " " + long, ""), (4, long, ""), (4, long, ""), (5, "...", "")]
    items = [(1, long, ""), (2, None, ""), (3, "", ""), (None, long, ""), (4, "one two", "")]
    got = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == [(1, 3), (1, 4)] or sorted((r.item_id, r.doc_id) for r in got) == [(1, 3), (1, 4), (1, 4)]
    assert find_leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
