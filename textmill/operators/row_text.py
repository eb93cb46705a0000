"""Cells to row text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import fold_case, strip
from textmill.operators.layout import Layout

# Cell spellings that read as missing.
NA_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SEPARATOR = " | "


def missing_to_null(c: Column) -> Column:
    """Null out empty cells and the usual spellings of a missing value."""
    return F.when(~c.isin(*NA_SPELLINGS), c)


def row_text(
    layout: Layout,
    include_column_names: bool = True,
    values_only_threshold: int = 2,
    normalization: str = "none",
    output_text_column: str = "",
    column_kept: Column | None = None,
) -> Column:
    """Text of a row.

    ``output_text_column`` alone is the text where the table has it and it is not
    entirely null; ``column_kept`` says so per source. Inner whitespace stays.
    """
    joined = layout.joined(SEPARATOR, include_column_names, values_only_threshold)
    if output_text_column:
        has = F.array_contains(layout.header(), output_text_column) if column_kept is None else column_kept
        joined = F.when(has, layout.cell(output_text_column)).otherwise(joined)
    return strip(fold_case(joined, normalization))


def row_map(layout: Layout, kept: Column | None = None) -> Column:
    """All kept columns of the row, blanks included."""
    row = layout.cells()
    if kept is not None:
        row = F.filter(row, lambda c: F.array_contains(kept, c["name"]))
    return F.map_from_entries(row)
