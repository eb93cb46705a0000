import math
import random
import re
from collections import Counter

import pytest

from textmill.llm import lexical_scan as ls

TERM = re.compile(ls.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, Counter(w), len(w)) for i, w in own if w]
    number, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, want in asked.items():
        scores = []
        for doc, counts, n in own:
            m = 50 + 50 * n * number // length
            score = 0
            for t in want & set(counts):
                w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * counts[t] // (1000 * counts[t] + 20 * m))
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, count=160):
    rng = random.Random(seed)
    words = ["Über", "straße", "a", "b1", "the", "THE", "x" * 90, "é" * 70, "\xa0", "日本", "I", "İ", "k"] + [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice(["", " ", "-"]) + "".join(rng.choice(words) + rng.choice([" ", "\n", "_", ".", "\x00", "`"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(count)]
    docs += [(3, docs[3][1]), (3, docs[3][1]), (3, docs[4][1]), (None, docs[5][1]), (900, None), (901, ""), (902, "... !"), (903, text(5000))]
    items = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(1, "w1 w2"), (None, "w3"), (None, "w4 the"), (77, None), (78, "absent")]
    return docs, items


def ranked(spark, docs, items, k=7):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    return sorted(map(tuple, ls.ranked_documents(d, "doc_id", "text", i, "item_id", "text", k).collect()), key=str)


def test_against_brute_force(spark):
    docs, items = corpus(1)
    assert ranked(spark, docs, items) == brute(docs, items, 7)


def test_several_automata_broadcasts_and_long_items(spark, monkeypatch):
    docs, items = corpus(2, 60)
    want = brute(docs, items, 5)
    monkeypatch.setattr(ls, "VOCABULARY_BYTES", 500)
    monkeypatch.setattr(ls, "PAIRS", 48)
    monkeypatch.setattr(ls, "BLOCK_CELLS", 64)
    assert ranked(spark, docs, items, 5) == want


def test_empty_tables(spark):
    docs, items = corpus(3, 8)
    assert ranked(spark, [], items) == [] == ranked(spark, docs, [])
    assert ranked(spark, [(1, None)], items) == []


@pytest.mark.parametrize("text", ["Aé_Z9|ß~x", "a b c", "\x7f\x80\x81"])
def test_terms(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(ls.terms_of("t")).first()[0]
    assert got == terms(text)
