"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.columns import as_column, let


def l2_normalize(c: Column | str) -> Column:
    """Unit-length float vector; a zero vector stays as it is."""
    v = as_column(c).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    scaled = let(F.sqrt(square), lambda n: F.transform(v, lambda x: x / F.when(n == 0.0, F.lit(1.0)).otherwise(n)))
    return scaled.cast("array<float>")
