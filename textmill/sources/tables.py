"""Delimited files of any header to rows with a ``cells`` column (A4, A5).

For files that are values anyway, such as members of archives: a file is cut into records
and fields by expressions. ``delimited.read_delimited_cells`` gives the same rows of files
on storage, which it splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.charset import decode_table
from textmill.functions.columns import let
from textmill.sources.fields import DELIMITERS, QUOTED, column_names, cut_rows, fields, records


def detect_delimiter(lines: Column) -> Column:
    """The delimiter that cuts the most of a file's ``lines``, its records, into the same number of fields.

    Ties go to more fields, then to the order of preference; without any of them
    the file is comma-separated.
    """

    def vote(lines: Column, rank: int) -> Column:
        sep = F.lit(DELIMITERS[rank])
        hits = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, sep, F.lit(""))))

        def mode(h: Column) -> Column:
            """The most frequent count, from the longest run of equal counts once they are sorted."""
            start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("hits"), F.lit(0).alias("best"), F.lit(0).alias("most"))

            def step(a: Column, n: Column) -> Column:
                lines = F.when(n == a["hits"], a["lines"] + 1).otherwise(1)
                ahead = lines >= a["best"]  # counts rise, so ties go to more fields
                return F.struct(
                    lines.alias("lines"),
                    n.alias("hits"),
                    F.when(ahead, lines).otherwise(a["best"]).alias("best"),
                    F.when(ahead, n).otherwise(a["most"]).alias("most"),
                )

            found = F.aggregate(F.sort_array(F.filter(h, lambda n: n > 0)), start, step)
            return let(
                found,
                lambda f: F.when(
                    f["best"] > 0, F.struct(f["best"].alias("lines"), f["most"].alias("hits"), F.lit(-rank).alias("rank"))
                ),
            )

        return let(hits, mode)

    def of(lines: Column) -> Column:
        best = F.array_max(F.array_compact(F.array(*[vote(lines, rank) for rank in range(len(DELIMITERS))])))
        return F.element_at(F.array(*[F.lit(s) for s in DELIMITERS]), 1 - F.coalesce(best["rank"], F.lit(0)))

    return let(F.transform(lines, lambda x: F.regexp_replace(x, QUOTED, "")), of)


def read_tables(files: DataFrame, *keep: str) -> DataFrame:
    """``(source_file, row_idx, cells)`` of ``files(source_file, content)``.

    A record with too many fields is skipped, one with too few is padded with
    nulls; missing-value spellings become null and rows without any value go.
    """
    text = files.select("source_file", *keep, decode_table("content").alias("_text"))
    # Columns used more than once are kept apart by Spark: a file is cut into records once.
    cut = text.select("source_file", *keep, records(F.col("_text")).alias("_records"))
    head = cut.withColumn("_sep", detect_delimiter(F.col("_records"))).withColumn("_names", let(fields(F.get("_records", F.lit(0)), F.col("_sep")), column_names))
    rows = head.select(
        "source_file", *keep, "_sep", "_names", F.posexplode(F.slice("_records", 2, F.greatest(F.size("_records"), F.lit(1)))).alias("row_idx", "_record")
    )
    return cut_rows(rows, *keep)
