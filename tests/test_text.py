import random

import pytest
from pyspark.sql import functions as F

from textmill.functions.sentences import ABBREVIATIONS, sentence_lengths, sentence_pieces
from textmill.functions.text import NOT_WS, WS, WS_CHARS, normalize, strip
from textmill.functions.tokens import WhitespaceCounter, word_count, word_starts, words

NORMALIZED = [
    ("a  b", "none", "a b"),
    ("﻿x​y", "none", "xy"),
    ("a  \r\n\t b", "none", "a\nb"),
    ("a\n\n\nb", "none", "a\n\n\nb"),
    ("  \n a \n ", "none", "a"),
    ("a \n \n b\r\rc\x0bd", "none", "a\n\nb c\x0bd"),
    ("İI", "lowercase", "i̇i"),
    ("straße", "uppercase", "STRASSE"),
    (None, "lowercase", ""),
    ("", "none", ""),
]

PIECES = [
    ("Dr. Ali geldi. Bkz. sayfa 3.14 dedi! A.Ş. (son.) Bitti?", "Dr. Ali geldi.¦ Bkz. sayfa 3.14 dedi!¦ A.Ş. (son.)¦ Bitti?"),
    ("He did it. Then he left.", "He did it. Then he left."),
    ("\"Hi.\" 'Yo!'] z", "\"Hi.\"¦ 'Yo!']¦ z"),
    ("a?! b. c", "a?!¦ b.¦ c"),
    ("İNG. test. ÇİN. son", "İNG.¦ test.¦ ÇİN.¦ son"),
    ("no end", "no end"),
    ("dr...... x. y", "dr...... x.¦ y"),
    ("x.dr. a", "x.dr.¦ a"),
    ("v.b. x. V.B.. y", "v.b. x.¦ V.B.. y"),
]


@pytest.mark.parametrize("mode", ["none", "lowercase", "uppercase"])
def test_normalize(spark, mode):
    cases = [(t, want) for t, m, want in NORMALIZED if m == mode]
    got = spark.createDataFrame(cases, "t string, want string").select(normalize("t", mode).alias("got"), "want", "t").collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_normalize_rejects_unknown_mode():
    with pytest.raises(ValueError):
        normalize("t", "title")


def test_whitespace_set_is_unicode_whitespace(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert {chr(i) for i in points if chr(i).isspace()} == set(WS_CHARS)
    rows = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    got = rows.select("c", F.col("c").rlike(f"[{WS}]").alias("ws"), F.col("c").rlike(NOT_WS).alias("other")).collect()
    assert all(r.ws == r.c.isspace() and r.other != r.ws for r in got)


def test_words_and_counts_follow_split(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t\n \x1c ") for _ in range(rng.randrange(30))) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", words("t").alias("w"), word_count("t").alias("n"), WhitespaceCounter().count("t").alias("c"), strip("t").alias("s")
    )
    for r in got.collect():
        assert r.w == r.t.split() and r.n == len(r.t.split()) and r.c == max(1, r.n) and r.s == r.t.strip()


def test_meter_counts_slices():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("abc  \n ") for _ in range(40))
        tokens = WhitespaceCounter().meter()()(text)
        a, b = sorted((rng.randrange(41), rng.randrange(41)))
        assert tokens(a, b) == max(1, len(text[a:b].split()))
    assert word_starts("").tolist() == []


def test_truncate(spark):
    df = spark.createDataFrame([("a  b c",), ("a b",), ("",)], "t string")
    assert [r.x for r in df.select(WhitespaceCounter().truncate("t", 2).alias("x")).collect()] == ["a b", "a b", ""]


def test_sentence_pieces(spark):
    got = spark.createDataFrame(PIECES, "t string, want string").select(
        "t", "want", F.array_join(sentence_pieces("t"), "¦").alias("got")
    )
    assert [(r.t, r.got) for r in got.collect()] == [(r.t, r.want) for r in got.collect()]


def boundaries(text: str) -> list[int]:
    """The rules one character at a time."""
    out = []
    for i, ch in enumerate(text):
        if ch not in ".!?":
            continue
        if ch == ".":
            j = i
            while j and (text[j - 1].isalpha() or text[j - 1] == "."):
                j -= 1
            if text[j:i].lower().rstrip(".") in ABBREVIATIONS:
                continue
        end = i + 1
        while end < len(text) and text[end] in "\"'“”‘’)]":
            end += 1
        if end == len(text) or text[end] in " \t\n\r":
            out.append(end)
    return out


def test_sentence_bounds_on_random_text(spark):
    rng = random.Random(11)
    parts = ["dr", "Dr", "a.ş", "no", "İt", "it", "K", "sk", "sK", "x", "word", ".", ".", "!", "?", " ", " ", "\n", '"', ")", "’", "3.1", "...", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", sentence_lengths("t").alias("n"), F.array_join(sentence_pieces("t"), "").alias("whole")
    )
    for r in got.collect():
        total, ends = 0, []
        for n in r.n:
            total += n
            ends.append(total)
        assert ends == sorted(set(boundaries(r.t))), r.t
        assert r.whole == r.t


def test_there_are_56_abbreviations():
    assert len(ABBREVIATIONS) == len(set(ABBREVIATIONS)) == 56
