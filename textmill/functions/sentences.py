"""Sentence boundaries (C2-C4) as one Java regular expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.columns import as_column, let

# Abbreviations whose period does not end a sentence.
ABBREVIATIONS = (
    "dr", "prof", "doc", "yrd", "öğr", "gör", "arş", "sr", "jr", "mr", "mrs", "ms", "phd", "md",
    "vs", "vb", "vd", "v.b", "v.d", "v.s", "yy", "ay", "ör", "bkz", "bknz", "hk", "sy", "sf", "s",
    "mad", "fık", "bend", "tel", "fax", "gsm", "no", "apt", "kat", "a.ş", "ltd", "şti", "tic",
    "san", "paz", "ing", "alm", "fr", "it", "rus", "çin", "st", "cd", "sk", "mah", "cad", "blv",
)

# What may follow a terminator and still belong to the sentence.
CLOSERS = "\"'“”‘’)\\]"


def _letter_class(ch: str) -> str:
    """All code points whose lower case is exactly ``ch``.

    A case-insensitive regex would fold the dotted capital I to i, which the
    rule does not.
    """
    if ch == ".":
        return r"\."
    candidates = {ch, ch.upper(), "\u212A"}
    return "[" + "".join(sorted(c for c in candidates if len(c) == 1 and c.lower() == ch)) + "]"


_ABBR = "|".join("".join(map(_letter_class, a)) for a in ABBREVIATIONS)


def _not_after_abbreviation(dots: str) -> str:
    return rf"(?<!(?<![\p{{L}}.])(?:{_ABBR})\.{{{dots}}})"


# Look-behinds are bounded: longer runs of dots than this are judged after the cut.
LONG_RUN = 1000

# The long look-behind runs only where several dots stand in a row (dot leaders).
_VETO = rf"(?:(?<!\.\.\.){_not_after_abbreviation('1,2')}|(?<=\.\.\.){_not_after_abbreviation(f'3,{LONG_RUN}')})"

# A sentence piece: everything up to and with the next boundary, or the rest.
PIECE = (
    rf"(?s).*?[.!?](?=[{CLOSERS}]*+(?:[ \t\n\r]|\z)){_VETO}[{CLOSERS}]*+"
    r"|.+\z"
)

# A piece that ends on an abbreviation and a longer run of dots goes on.
LONG_VETO = rf"(?<![\p{{L}}.])(?:{_ABBR})\.{{{LONG_RUN + 1},}}+[{CLOSERS}]*+\z"


def sentence_pieces(c: Column | str) -> Column:
    """The text cut after each sentence; the pieces put together give the text."""
    found = F.regexp_extract_all(as_column(c), F.lit(PIECE), F.lit(0))

    def joined(out: Column, piece: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when((F.size(out) > 0) & F.get(out, F.size(out) - 1).rlike(LONG_VETO), F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, piece))
        )).otherwise(F.array_append(out, piece))

    def checked(pieces: Column) -> Column:
        mended = F.aggregate(pieces, F.array().cast("array<string>"), joined)
        return F.when(F.exists(pieces, lambda p: p.rlike(LONG_VETO)), mended).otherwise(pieces)

    return let(found, checked)


def sentence_lengths(c: Column | str) -> Column:
    """Lengths of the pieces that end on a boundary; their running sum are the offsets.

    Every piece but the last does; the last only if the text ends on a terminator.
    """
    return let(
        sentence_pieces(c),
        lambda p: F.slice(
            F.transform(p, F.length),
            F.lit(1),
            F.size(p) - F.when(closes_sentence(F.get(p, F.size(p) - 1)), F.lit(0)).otherwise(F.lit(1)),
        ),
    )


def closes_sentence(piece: Column) -> Column:
    """Whether a piece ends on a boundary of its own."""
    return piece.rlike(rf"[.!?]{_VETO}[{CLOSERS}]*+\z")
