"""Records and fields of delimited text, as expressions (A4, A5).

A line break ends a record unless an odd number of quotes stands before it; a last quote that
nothing closes counts as a plain character, so that it cannot swallow the rest of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.columns import let
from textmill.operators.row_text import missing_to_null

# Delimiters tried, in order of preference.
DELIMITERS = (",", ";", "\t", "|")

QUOTED = r'"(?:[^"]|"")*+"'

# Text without breaks, quoted stretches with any, or a quote without a second one behind it.
RECORD = r'(?:[^"\r\n]++|"[^"]*+"|")++'


def records(text: Column) -> Column:
    """Non-empty records of a delimited text."""
    return F.regexp_extract_all(text, F.lit(RECORD), F.lit(0))


def fields(record: Column, sep: Column) -> Column:
    """Fields of a record without their quotes; an empty one is the empty string."""
    s = F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))
    pattern = F.concat(F.lit('"(?:[^"]++|"")*+"?+(?:(?!'), s, F.lit(").)*+|(?:(?!"), s, F.lit(").)*+"))
    # With a separator in front every field is introduced by one, also an empty one.
    found = F.regexp_extract_all(F.concat(sep, record), F.concat(s, F.lit("((?s:"), pattern, F.lit("))")), F.lit(1))
    plain = lambda f: F.replace(F.regexp_replace(f, r'(?s)\A"(.*?)"?\z', "$1"), F.lit('""'), F.lit('"'))
    quoted = F.transform(found, lambda f: F.when(f.startswith('"'), plain(f)).otherwise(f))
    cut = None
    for mark in DELIMITERS:  # fixed patterns of one character, which need no matching
        parts = F.split(record, "\\|" if mark == "|" else mark, -1)
        cut = F.when(sep == mark, parts) if cut is None else cut.when(sep == mark, parts)
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.coalesce(cut, quoted))


def column_names(header: Column) -> Column:
    """Names from a header record: blanks get their position, repeats the first free running number."""
    blank = lambda h, i: F.when(h == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(h)

    def add(out: Column, name: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(1), F.size(out) + 1), lambda n: F.concat(name, F.lit("."), n.cast("string"))
        )
        free = F.filter(numbered, lambda n: ~F.array_contains(out, n))[0]
        return F.array_append(out, F.when(F.array_contains(out, name), free).otherwise(name))

    return F.aggregate(F.transform(header, blank), F.array().cast("array<string>"), add)


def cut_rows(found: DataFrame, *keep: str) -> DataFrame:
    """``(source_file, row_idx, cells)`` of records ``(source_file, row_idx, _record, _sep, _names)``.

    A record with too many fields is skipped, one with too few is padded with nulls;
    missing-value spellings become null and rows without any value go.
    """

    def cells(parts: Column) -> Column:
        return F.transform(
            "_names", lambda n, i: F.struct(n.alias("name"), missing_to_null(F.get(parts, i)).alias("val"))
        )

    def kept(parts: Column) -> Column:
        whole = let(cells(parts), lambda c: F.when(F.exists(c, lambda x: x["val"].isNotNull()), F.array(c)))
        return F.when(F.size(parts) <= F.size("_names"), whole)

    # Generated: filters would be pushed below the columns they test and cut every record again.
    return found.select(
        "source_file",
        F.col("row_idx").cast("bigint").alias("row_idx"),
        F.explode(let(fields(F.col("_record"), F.col("_sep")), kept)).alias("cells"),
        *keep,
    )
