"""How the cells of a table row are stored.

``Columns`` is the usual case, one string column per cell. ``CellArray`` holds the
row as ``array<struct<name, val>>``, so that tables with different headers share
one DataFrame and one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.columns import let
from textmill.functions.text import is_blank, to_text

KEYS = ("source_file", "row_idx", "_blk")
CELLS = "cells"
CELL_TYPE = "array<struct<name:string,val:string>>"


class Columns:
    """One column per cell; every row has the same header."""

    def __init__(self, names: list[str]):
        self.names = list(names)

    def stored(self) -> list[Column]:
        return [F.col(f"`{n}`") for n in self.names]

    def header(self) -> Column:
        return F.array(*[F.lit(n) for n in self.names])

    def cells(self) -> Column:
        """The row as ``array<struct<name, val>>``, nulls as empty strings."""
        return F.array(
            *[F.struct(F.lit(n).alias("name"), to_text(F.col(f"`{n}`")).alias("val")) for n in self.names]
        )

    def cell(self, name: str) -> Column:
        return to_text(F.col(f"`{name}`")) if name in self.names else F.lit("")

    def has_text(self) -> Column:
        """Whether any cell holds more than whitespace."""
        out = F.lit(False)
        for n in self.names:
            out = out | ~is_blank(to_text(F.col(f"`{n}`")))
        return out

    def filled(self) -> Column:
        """Number of cells with text."""
        out = F.lit(0)
        for n in self.names:
            out = out + (~is_blank(to_text(F.col(f"`{n}`")))).cast("int")
        return out

    def line(self, separator: str) -> Column:
        """All cells of the row on one line, blank ones included."""
        return F.concat_ws(separator, *[to_text(F.col(f"`{n}`")) for n in self.names])

    def joined(self, separator: str, include_names: bool, values_only_threshold: int) -> Column:
        """Non-blank cells on one line, with their names unless few are filled."""

        def text(named: bool) -> Column:
            value = lambda n: F.concat(F.lit(f"{n}: "), F.col(f"`{n}`").cast("string")) if named else F.col(f"`{n}`").cast("string")
            return F.concat_ws(separator, *[F.when(~is_blank(to_text(F.col(f"`{n}`"))), value(n)) for n in self.names])

        if not include_names:
            return text(False)
        return F.when(self.filled() <= values_only_threshold, text(False)).otherwise(text(True))

    def headers(self) -> list[Column]:
        """Aggregates that ``header_of`` needs: none, as every row has the same header."""
        return []

    def header_of(self) -> Column:
        return self.header()

    def used(self) -> list[Column]:
        """Aggregates telling which columns hold a value; see ``used_names``."""
        return [F.count(F.col(f"`{n}`")).alias(f"_n{i}") for i, n in enumerate(self.names)]

    def used_names(self) -> Column:
        return F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 0, F.lit(n)) for i, n in enumerate(self.names)]))


class CellArray:
    """The row in one ``cells`` column; headers may differ between sources."""

    def stored(self) -> list[Column]:
        return [F.col(CELLS)]

    def header(self) -> Column:
        return F.col(CELLS)["name"]

    def cells(self) -> Column:
        return F.transform(CELLS, lambda c: F.struct(c["name"].alias("name"), to_text(c["val"]).alias("val")))

    def cell(self, name: str) -> Column:
        found = F.filter(CELLS, lambda c: c["name"] == name)
        return F.coalesce(F.get(found, F.lit(0))["val"], F.lit(""))

    def has_text(self) -> Column:
        return F.exists(CELLS, lambda c: c["val"].isNotNull() & ~is_blank(c["val"]))

    def filled(self) -> Column:
        return F.size(F.filter(CELLS, lambda c: c["val"].isNotNull() & ~is_blank(c["val"])))

    def line(self, separator: str) -> Column:
        return F.array_join(F.transform(CELLS, lambda c: to_text(c["val"])), separator)

    def joined(self, separator: str, include_names: bool, values_only_threshold: int) -> Column:
        def text(filled: Column) -> Column:
            values = F.array_join(filled["val"], separator)
            if not include_names:
                return values
            named = F.array_join(F.transform(filled, lambda c: F.concat(c["name"], F.lit(": "), c["val"])), separator)
            return F.when(F.size(filled) <= values_only_threshold, values).otherwise(named)

        return let(F.filter(self.cells(), lambda c: ~is_blank(c["val"])), text)

    def headers(self) -> list[Column]:
        return [F.any_value(self.header()).alias("_header")]

    def header_of(self) -> Column:
        return F.col("_header")

    def used(self) -> list[Column]:
        # Distinct sets of filled columns within one block of rows.
        present = F.filter(CELLS, lambda c: c["val"].isNotNull())["name"]
        return [F.collect_set(present).alias("_used")]

    def used_names(self) -> Column:
        return F.array_distinct(F.flatten("_used"))


Layout = Columns | CellArray


def layout_of(rows: DataFrame, columns: list[str] | None = None) -> Layout:
    if columns is None and CELLS in rows.columns and rows.schema[CELLS].dataType.simpleString() == CELL_TYPE:
        return CellArray()
    return Columns(columns if columns is not None else [c for c in rows.columns if c not in KEYS])
