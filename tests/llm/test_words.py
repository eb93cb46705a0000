import re

import numpy as np
import pyarrow as pa

from textmill.llm import words as w

TEXTS = ["", None, "a", " a  b\tc\x0bd\n", "é ß 語 x", "one two three four five", "  ", "A b A b A b", "x" * 500]
PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_runs_of_other_characters():
    for low, high, data, offsets in w.pieces(pa.array(TEXTS), 10):
        starts, ends, hashes, owner = w.words(data, offsets)
        for i in range(low, high):
            mine = [bytes(data[a:b]).decode() for a, b, o in zip(starts, ends, owner) if o == i - low]
            assert mine == PATTERN.findall(TEXTS[i] or "")
        assert len(set(zip(hashes.tolist(), [bytes(data[a:b]) for a, b in zip(starts, ends)]))) == len(set(hashes.tolist()))


def test_a_long_text_is_hashed_like_a_short_one(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "y" * 300
    _, _, data, offsets = next(w.pieces(pa.array([text])))
    whole = w.words(data, offsets)
    monkeypatch.setattr(w, "PIECE_BYTES", 64)
    parts = w.words(data, offsets)
    for a, b in zip(whole, parts):
        assert (a == b).all()


def test_lower_case_touches_ascii_only():
    _, _, data, offsets = next(w.pieces(pa.array(["ABC É", "abc É", "abc é"])))
    _, _, hashes, owner = w.words(data, offsets, lower=True)
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[5]


def test_shingles_are_distinct_and_short_texts_are_one():
    texts = ["a b c d e", "a b a b a b a b", "a b", "", "a", "a b c d"]
    _, _, data, offsets = next(w.pieces(pa.array(texts)))
    _, _, hashes, owner = w.words(data, offsets)
    who, value = w.shingles(hashes, owner, len(texts), 4)
    assert np.bincount(who, minlength=6).tolist() == [2, 2, 1, 0, 1, 1]
    assert value[who == 5][0] in value[who == 0]
