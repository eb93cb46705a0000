"""Error codes, messages and the quarantine split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error codes a bad input is filed under.
INVALID_FILE = "INVALID_FILE"
UNSUPPORTED_FORMAT = "UNSUPPORTED_FORMAT"
ZIP_PASSWORD_REQUIRED = "ZIP_PASSWORD_REQUIRED"
ZIP_WRONG_PASSWORD = "ZIP_WRONG_PASSWORD"
TOO_MANY_ROWS = "TOO_MANY_ROWS"
FILE_TOO_LARGE = "FILE_TOO_LARGE"
PROCESSING_ERROR = "PROCESSING_ERROR"
INVALID_PARAMETER = "INVALID_PARAMETER"


# The texts below are the messages users of the error records know.


def unsupported_format(name: Column, ext: Column) -> Column:
    return F.format_string("Unsupported file format: '%s' (file: %s)", ext, name)


def invalid_file(name: Column, reason: Column | str = "") -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.concat(
        F.format_string("Cannot read file: '%s'", name), F.when(reason != "", F.concat(F.lit(" - "), reason)).otherwise("")
    )


def zip_password_required(name: Column) -> Column:
    return F.format_string("ZIP file '%s' is password-protected. Provide zip_password.", name)


def too_many_rows(name: Column, rows: Column, limit: int) -> Column:
    return F.concat(
        F.format_string("Dosya '%s' çok fazla satır içeriyor: ", name),
        F.format_number(rows, 0),
        F.lit(f" (limit: {limit:,})"),
    )


def file_too_large(name: Column, limit: int) -> Column:
    return F.concat(F.format_string("Dosya '%s' boyutu limiti aşıyor: ", name), F.lit(f"{limit // (1024 * 1024)}MB"))


def archive_too_large(name: Column, total: Column, limit: int) -> Column:
    mb = 1024 * 1024
    return invalid_file(
        name,
        F.concat(
            F.lit("ZIP decompressed boyutu çok büyük: "),
            F.format_string("%.0f", total / mb),
            F.lit(f"MB (limit: {limit / mb:.0f}MB)"),
        ),
    )


def processing_errors(failed: DataFrame, reason: Column) -> DataFrame:
    """Error records of inputs whose processing failed; one per input and reason."""
    return failed.select(
        "source_file",
        F.lit(PROCESSING_ERROR).alias("error_code"),
        F.format_string("Cannot process file: '%s'", F.col("source_file")).alias("message"),
        reason.cast("string").alias("detail"),
    ).distinct()


def first_error(*checks: tuple[Column, str, Column]) -> Column:
    """The first failing check as ``struct<error_code, message, detail>``, else null."""
    chain = None
    for failed, code, message in checks:
        error = F.struct(F.lit(code).alias("error_code"), message.alias("message"), F.lit(None).cast("string").alias("detail"))
        chain = F.when(failed, error) if chain is None else chain.when(failed, error)
    return chain


def split_errors(df: DataFrame, error: Column, name: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the failing ones as error records.

    ``error`` is a column, so a bad input never fails the job.
    """
    checked = df.withColumn("_error", error)
    good = checked.where(F.col("_error").isNull()).drop("_error")
    bad = checked.where(F.col("_error").isNotNull()).select(
        F.col(name).alias("source_file"), "_error.error_code", "_error.message", "_error.detail"
    )
    return good, bad
