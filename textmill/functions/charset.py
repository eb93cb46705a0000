"""Bytes to text without a Python worker (A3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.columns import as_column


def differences(codec: str) -> tuple[str, str]:
    """Characters a Latin-1 decoding gets wrong, and what ``codec`` makes of the same bytes."""
    wrong, right = [], []
    for byte in range(0x80, 0x100):
        try:
            ch = bytes([byte]).decode(codec)
        except UnicodeDecodeError:
            continue
        if ch != chr(byte):
            wrong.append(chr(byte))
            right.append(ch)
    return "".join(wrong), "".join(right)


# Bytes windows-1254 does not define; a text with one of them is read as iso-8859-9.
UNDEFINED_1254 = r"[\x81\x8d\x8e\x8f\x90\x9d\x9e]"


def decode_text(content: Column | str) -> Column:
    """UTF-8, else windows-1254, else iso-8859-9: the first that decodes the bytes."""
    raw = as_column(content)
    as_utf8 = raw.cast("string")
    latin = F.decode(raw, "ISO-8859-1")
    return (
        F.when(F.is_valid_utf8(as_utf8), as_utf8)
        .when(latin.rlike(UNDEFINED_1254), F.translate(latin, *differences("iso8859_9")))
        .otherwise(F.translate(latin, *differences("cp1254")))
    )


def _utf16(first: str, second: str) -> str:
    """Hex digits of well-formed UTF-16 whose bytes of a unit stand in the order given.

    ``first`` and ``second`` place the high byte (``H``) and the low byte (``..``).
    """
    unit = (first + second).replace("H", "(?:[0-9A-CEF].|D[0-7])")
    high = (first + second).replace("H", "D[89AB]")
    low = (first + second).replace("H", "D[C-F]")
    return rf"\A(?:{unit}|{high}{low})*+\z"


def decode_table(content: Column | str) -> Column:
    """Text of a delimited file: UTF-16 where a byte order mark says so, NULs removed (A4).

    Bytes that are not UTF-16 in spite of their mark are decoded like other texts.
    """
    raw = as_column(content)
    mark, digits = F.hex(F.substring(raw, 1, 2)), F.hex(raw)
    wide = ((mark == "FEFF") & digits.rlike(_utf16("H", ".."))) | ((mark == "FFFE") & digits.rlike(_utf16("..", "H")))
    text = F.when(wide, F.decode(raw, "UTF-16")).otherwise(decode_text(raw))
    return F.regexp_replace(F.regexp_replace(text, "\\x00", ""), "\\A\\uFEFF", "")
