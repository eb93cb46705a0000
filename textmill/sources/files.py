"""Discovery and reading of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill import errors
from textmill.functions.charset import decode_text
from textmill.options import Limits

# Accepted extensions and the branch each one takes.
TEXT_EXTENSIONS = (".pdf", ".docx", ".txt")
TABLE_EXTENSIONS = (".csv", ".xlsx", ".xls")
ARCHIVE_EXTENSIONS = (".zip",)
SUPPORTED = TEXT_EXTENSIONS + TABLE_EXTENSIONS + ARCHIVE_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; leading dots belong to the name."""
    return F.lower(F.regexp_extract(file_name(name), r"\A\.*[^.].*(\.[^.]*)\z", 1))


def route(ext: Column) -> Column:
    """Branch a file takes: text, table or archive; null where it is not supported (A2)."""
    return (
        F.when(ext.isin(*TEXT_EXTENSIONS), "text")
        .when(ext.isin(*TABLE_EXTENSIONS), "table")
        .when(ext.isin(*ARCHIVE_EXTENSIONS), "archive")
    )


def file_error(name: Column, size: Column, limits: Limits) -> Column:
    """Why a file is refused: its size first, then its format."""
    ext = extension(name)
    most = limits.max_file_bytes
    large = [] if most is None else [(size > most, errors.FILE_TOO_LARGE, errors.file_too_large(name, most))]
    return errors.first_error(
        *large,
        (~ext.isin(*SUPPORTED), errors.UNSUPPORTED_FORMAT, errors.unsupported_format(name, ext)),
    )


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, source_file, file_ext, length)`` of all files below ``path``, without reading them.

    A file is named by its path everywhere, as base names repeat.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("path").alias("source_file"), extension(F.col("path")).alias("file_ext"), "length")


def discover(spark: SparkSession, path: str | list[str], limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Accepted files with their branch, and the errors of the refused ones."""
    files = list_files(spark, path)
    good, bad = errors.split_errors(files, file_error(F.col("source_file"), F.col("length"), limits))
    return good.withColumn("branch", route(F.col("file_ext"))), bad


def read_bytes(spark: SparkSession, path: str | list[str], ext: str, limits: Limits = Limits()) -> DataFrame:
    """``(path, source_file, file_ext, content)`` of the files of one extension.

    Where a size limit is set, larger files are left out, which ``discover`` reports.
    Both conditions reach the scan: other files are not opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext))
        .load(path)
    )
    if limits.max_file_bytes is not None:
        files = files.where(F.col("length") <= limits.max_file_bytes)
    return files.select("path", F.col("path").alias("source_file"), F.lit(ext).alias("file_ext"), "content")


def read_text(spark: SparkSession, path: str | list[str], limits: Limits = Limits()) -> DataFrame:
    """Documents of the ``.txt`` files: ``(source_file, text, file_ext)``."""
    return read_bytes(spark, path, ".txt", limits).select("source_file", decode_text("content").alias("text"), "file_ext")
