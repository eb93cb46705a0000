"""Small helpers shared by the Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Expressions inside a lambda are not shared by the optimizer, and a column
    referenced once is inlined even where the reference sits in a lambda. Bound
    through a one-element ``transform`` the value is computed a single time.
    """
    return F.transform(F.array(value), body)[0]


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
