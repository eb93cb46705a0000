"""Job options with their defaults and enforced ranges (F8)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill import errors
from textmill.functions.tokens import DEFAULT_COUNTER

NORMALIZATIONS = ("none", "lowercase", "uppercase")
RESULT_FORMATS = ("json", "json_with_embeddings", "zip")
PREFIX_MODES = ("passage", "query")


# Least and greatest values of the options that have a range.
RANGES: dict[str, tuple[int, int | None]] = {
    "max_tokens": (1, 32768),
    "overlap": (0, None),
    "embedding_batch_size": (1, 512),
    "values_only_threshold": (0, 10),
    "min_cols_for_table": (1, None),
    "min_rows_for_table": (1, None),
}
CHOICES = {"normalization": NORMALIZATIONS, "response_format": RESULT_FORMATS, "prefix_mode": PREFIX_MODES}


def option_error(columns: list[str]) -> Column:
    """What is wrong with the options in ``columns`` of a table of job requests, as an error column; null where nothing is.

    The same rules as of :class:`JobOptions`, in the same order; a null stands for the default.
    """
    checks = []
    for name, allowed in CHOICES.items():
        if name in columns:
            checks.append((~F.col(name).isin(*allowed), F.format_string(f"{name} must be one of {', '.join(allowed)}, got '%s'", F.col(name))))
    for name, (low, high) in RANGES.items():
        if name in columns:
            wrong = F.col(name) < low if high is None else ~F.col(name).between(low, high)
            bound = f"at least {low}" if high is None else f"between {low} and {high}"
            checks.append((wrong, F.format_string(f"{name} must be an integer {bound}, got %d", F.col(name))))
    if {"max_tokens", "overlap"} <= set(columns):
        checks.append((F.col("overlap") >= F.col("max_tokens"), F.lit("overlap must be below max_tokens")))
    return errors.first_error(*[(wrong, errors.INVALID_PARAMETER, message) for wrong, message in checks])


def _in_range(name: str, value: int | None, low: int, high: int | None = None) -> None:
    if value is None:
        return
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        bound = f"between {low} and {high}" if high is not None else f"at least {low}"
        raise ValueError(f"INVALID_PARAMETER: {name} must be an integer {bound}, got {value!r}")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"INVALID_PARAMETER: {name} must be one of {', '.join(allowed)}, got {value!r}")


@dataclass(frozen=True)
class Limits:
    """Size limits of the inputs a caller may set; what exceeds them goes to the errors.

    None, the default, is no limit: large inputs are processed.
    """

    max_table_rows: int | None = None
    max_file_bytes: int | None = None
    max_archive_bytes: int | None = None

    def __post_init__(self) -> None:
        for name in ("max_table_rows", "max_file_bytes", "max_archive_bytes"):
            _in_range(name, getattr(self, name), 1)


@dataclass(frozen=True)
class JobOptions:
    """Options of a chunking and embedding job."""

    model_name: str | None = "all-MiniLM-L6-v2"
    normalization: str = "none"
    max_tokens: int = 512
    overlap: int = 100
    skip_embedding: bool = False
    response_format: str = "json"
    embedding_batch_size: int = 32
    prefix_mode: str = "passage"
    zip_password: str | None = None
    include_column_names: bool = True
    attach_row_data: bool = True
    flatten_row_values_to_root: bool = True
    output_text_column: str = ""
    values_only_threshold: int = 2
    min_cols_for_table: int | None = 2
    min_rows_for_table: int | None = 2
    attach_context_on_split: bool = True
    # "pack" fills chunks sentence by sentence; "exact" follows the ratio rule.
    chunk_mode: str = "pack"
    counter: object = DEFAULT_COUNTER
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            _one_of(name, getattr(self, name), allowed)
        _one_of("chunk_mode", self.chunk_mode, ("pack", "exact"))
        for name, (low, high) in RANGES.items():
            _in_range(name, getattr(self, name), low, high)
        if self.overlap >= self.max_tokens:
            raise ValueError("INVALID_PARAMETER: overlap must be below max_tokens")
        if self.chunk_mode == "pack" and not self.counter.additive:
            raise ValueError("INVALID_PARAMETER: pack mode needs an additive token counter; use chunk_mode='exact'")
