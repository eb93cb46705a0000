"""Text normalization (B1-B8) as native Column expressions.

Every pattern is written so that matching stays linear in the text length, also
on long runs of blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.columns import as_column, let

# Unicode whitespace. Java's own \s covers ASCII only.
_WS_LATIN = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
_WS_WIDE = "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = _WS_LATIN + _WS_WIDE

# The same set inside a regex class. Latin characters are listed one by one and
# the rest sits behind one range check, which keeps the class cheap to test.
WS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
NOT_WS = rf"[^{WS}]"

CASE_MODES = ("none", "lowercase", "uppercase")


def strip(c: Column | str) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.btrim(as_column(c), F.lit(WS_CHARS))


def is_blank(c: Column | str) -> Column:
    # Looking at one end is enough and stops at the first other character.
    return F.ltrim(as_column(c), F.lit(WS_CHARS)) == ""


def to_text(c: Column | str) -> Column:
    """Any value as a string, null as the empty string."""
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def fold_case(c: Column, mode: str) -> Column:
    """Locale-free case change."""
    if mode == "lowercase":
        return F.lower(c)
    if mode == "uppercase":
        return F.upper(c)
    if mode == "none":
        return c
    raise ValueError(f"normalization must be one of {CASE_MODES}, got {mode!r}")


def _has_any(c: Column, *needles: str) -> Column:
    out = F.contains(c, F.lit(needles[0]))
    for n in needles[1:]:
        out = out | F.contains(c, F.lit(n))
    return out


def _where(found: Column, replaced: Column, c: Column) -> Column:
    """Run a pattern only over texts it can change; looking for bytes first is far cheaper."""
    return F.when(found, replaced).otherwise(c)


def unify_spaces(c: Column) -> Column:
    """NBSP and narrow NBSP become plain spaces (B2)."""
    return F.regexp_replace(c, r"[\u00A0\u202F]", " ")


def drop_zero_width(c: Column) -> Column:
    """Zero-width characters and byte order marks go."""
    return F.regexp_replace(c, r"[\u200B-\u200D\uFEFF]", "")


def visible_text(c: Column) -> Column:
    """Both of them, for texts that hold any such character."""
    special = _has_any(c, "\u00a0", "\u202f", "\u200b", "\u200c", "\u200d", "\ufeff")
    return _where(special, drop_zero_width(unify_spaces(c)), c)


def tidy_blanks(c: Column) -> Column:
    """Runs of blanks collapse to one space and vanish next to a newline.

    Collapsing first leaves at most one space on each side of a newline, so the
    second pattern needs no repetition.
    """

    def collapse(t: Column) -> Column:
        return _where(_has_any(t, "  ", "\t", "\f", "\r"), F.regexp_replace(t, r"[ \t\f\r]{2,}+|[\t\f\r]", " "), t)

    def join_lines(t: Column) -> Column:
        return _where(_has_any(t, " \n", "\n "), F.regexp_replace(t, " ?\n ?", "\n"), t)

    return let(c, lambda t: let(collapse(t), join_lines))


def normalize(c: Column | str, mode: str = "none") -> Column:
    """The whole normalizer (B8): one chain of expressions, no shuffle, no Python."""
    return fold_case(strip(tidy_blanks(visible_text(to_text(c)))), mode)
