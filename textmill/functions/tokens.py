"""Token counters (C1): what the chunkers and the truncation measure texts with.

``WhitespaceCounter`` is the default and stays in the JVM. ``SubwordCounter``
wraps a local ``tokenizer.json`` in Arrow-batched functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.columns import as_column, let
from textmill.functions.text import NOT_WS, WS, WS_CHARS, strip


def words(c: Column | str) -> Column:
    """Whitespace-separated words as an array; blank text has none."""
    return F.filter(F.split(strip(c), rf"[{WS}]+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of words, without building the word array."""
    return F.length(F.regexp_replace(strip(c), rf"{NOT_WS}++[{WS}]*+", "x"))


# Tokens of a slice of one text, by its start and end.
Meter = Callable[[int, int], int]


def word_starts(text: str) -> np.ndarray:
    """Offsets at which the words of a text begin."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = np.isin(codes, np.array([ord(c) for c in WS_CHARS], dtype=np.uint32), kind="table")
    return np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))


def subword_count(tokenizer, text: str) -> int:
    """Tokens of a text; the number of its words where it cannot be encoded."""
    try:
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    except Exception:
        return max(1, len(text.split()))


@dataclass(frozen=True)
class WhitespaceCounter:
    """Counts words; a blank text counts as one token."""

    # Cutting at whitespace never changes the sum of the counts.
    additive: bool = True

    def count(self, c: Column | str) -> Column:
        return F.greatest(F.lit(1), word_count(c))

    def truncate(self, c: Column | str, limit: Column | int) -> Column:
        """First ``limit`` words where the text has more, else the text unchanged."""
        text, limit = as_column(c), limit if isinstance(limit, Column) else F.lit(limit)
        cut = let(words(text), lambda w: F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, limit), " ")))
        return F.coalesce(cut, text)

    def meter(self) -> Callable[[], Callable[[str], Meter]]:
        def make() -> Callable[[str], Meter]:
            def measure(text: str) -> Meter:
                # Counted once per text: a slice holds the words starting in it, and
                # one more where it starts inside a word.
                starts = word_starts(text)

                def tokens(start: int, stop: int) -> int:
                    n = int(np.searchsorted(starts, stop) - np.searchsorted(starts, start))
                    inside = 0 < start < stop and not text[start].isspace() and not text[start - 1].isspace()
                    return max(1, n + inside)

                return tokens

            return measure

        return make


@dataclass(frozen=True)
class SubwordCounter:
    """Counts subword tokens with a tokenizer file every worker can read.

    The tokenizer is loaded once per Python worker. Where a text cannot be
    encoded the word count stands in, as for the whitespace counter.
    """

    path: str
    additive: bool = False

    def _load(self) -> Callable[[], object]:
        path = self.path

        def load():
            import tokenizers

            cache = tokenizers.__dict__.setdefault("_textmill_cache", {})
            if path not in cache:
                cache[path] = tokenizers.Tokenizer.from_file(path)
            return cache[path]

        return load

    def meter(self) -> Callable[[], Callable[[str], Meter]]:
        load = self._load()

        def make() -> Callable[[str], Meter]:
            tok = load()

            def measure(text: str) -> Meter:
                return lambda start, stop: subword_count(tok, text[start:stop])

            return measure

        return make

    def count(self, c: Column | str) -> Column:
        load = self._load()

        @F.pandas_udf("int")
        def count_tokens(texts: pd.Series) -> pd.Series:
            tok = load()
            return texts.fillna("").map(lambda t: subword_count(tok, t))

        return count_tokens(as_column(c))

    def truncate(self, c: Column | str, limit: Column | int) -> Column:
        load = self._load()

        @F.pandas_udf("string")
        def cut(texts: pd.Series, limits: pd.Series) -> pd.Series:
            tok = load()

            def one(text: str, limit: int) -> str:
                try:
                    ids = tok.encode(text, add_special_tokens=False).ids
                    return text if len(ids) <= limit else tok.decode(ids[:limit], skip_special_tokens=True)
                except Exception:  # counted in words, so cut in words
                    return " ".join(text.split()[:limit])

            return pd.Series([one(t, n) for t, n in zip(texts.fillna(""), limits)], dtype="object")

        return cut(as_column(c), (limit if isinstance(limit, Column) else F.lit(limit)).cast("int"))


DEFAULT_COUNTER = WhitespaceCounter()
