"""Folder to chunks: every reader and chunker in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill import errors
from textmill.functions.charset import decode_text
from textmill.operators.documents import chunk_documents_checked
from textmill.operators.embed import embed, embedding_errors
from textmill.operators.row_chunks import chunk_tables
from textmill.options import JobOptions
from textmill.session import materialize, ship_package
from textmill.sources.archives import INNER, archive_policy, read_manifest, read_members
from textmill.sources.delimited import read_delimited_cells
from textmill.sources.files import discover, read_bytes
from textmill.sources.sinks import write_results
from textmill.sources.tables import read_tables

READABLE = (".txt", ".csv")


def _no_reader(files: DataFrame) -> DataFrame:
    """Accepted formats this library does not parse are errors, not silently left out."""
    return files.select(
        "source_file",
        F.lit(errors.INVALID_FILE).alias("error_code"),
        errors.invalid_file(F.col("source_file"), F.concat(F.lit("no reader for "), F.col("file_ext"))).alias("message"),
        F.lit(None).cast("string").alias("detail"),
    )


def _members(spark: SparkSession, path: str | list[str], options: JobOptions) -> tuple[DataFrame, list[DataFrame]]:
    """Members of the archives as files of their own."""
    archives = read_bytes(spark, path, ".zip", options.limits).select(F.col("path").alias("source_file"), "content")
    listed, broken = read_manifest(archives)
    manifest = materialize(listed)
    wanted, refused = archive_policy(manifest, options.zip_password is not None, options.limits)
    wanted = wanted.withColumn("_key", F.concat("container_file", F.lit(INNER), "source_file"))
    read = wanted.where(F.col("file_ext").isin(*READABLE))
    members, unreadable = read_members(archives, read, options.zip_password)
    files = members.select(
        F.concat("container_file", F.lit(INNER), "source_file").alias("source_file"), "file_ext", "content"
    )
    other = wanted.where(~F.col("file_ext").isin(*READABLE)).withColumn("source_file", F.col("_key"))
    return files, [broken, refused, unreadable, _no_reader(other)]


def process_folder(
    spark: SparkSession, path: str | list[str], options: JobOptions = JobOptions(), embedder=None
) -> tuple[DataFrame, DataFrame]:
    """Chunks of all files below ``path`` (a folder, or several folders or files), and the errors of those that failed.

    Chunks carry the path of the file they came from as ``container_file``; their
    ``source_file``, like that of an error, is this path, or for an archive member the
    path, ``!/`` and the member's own path. One bad file never stops the others.
    """
    ship_package()
    found, refused = discover(spark, path, options.limits)
    found = found.withColumn("source_file", F.col("path"))
    members, failed = _members(spark, path, options)
    failed += [refused, _no_reader(found.where(~F.col("file_ext").isin(*READABLE, ".zip")))]

    def files(ext: str) -> DataFrame:
        own = read_bytes(spark, path, ext, options.limits).select(F.col("path").alias("source_file"), "content")
        return own.unionByName(members.where(F.col("file_ext") == ext).select("source_file", "content"))

    texts = files(".txt").select("source_file", decode_text("content").alias("text"))
    # Tables on storage are cut at their records, whatever their size; members are values.
    own = read_delimited_cells(spark, path, glob="*.[cC][sS][vV]", max_bytes=options.limits.max_file_bytes)
    cells = own.unionByName(read_tables(members.where(F.col("file_ext") == ".csv").select("source_file", "content")))
    # Parsed once; the table passes then read columns instead of parsing files again.
    tables = materialize(cells)
    rows, bad_tables = chunk_tables(tables, options, ".csv")
    of_texts, bad_texts = chunk_documents_checked(texts, options)
    chunks = of_texts.unionByName(rows.drop("row_idx"))
    failed += [bad_tables, bad_texts]

    named = chunks.withColumn("container_file", F.split("source_file", INNER)[0])
    if embedder is not None and not options.skip_embedding:
        # Written once: the vectors are what costs, and chunks, matrices and errors all read them.
        named = materialize(embed(named, embedder, options))
        failed.append(embedding_errors(named))
    bad = failed[0]
    for frame in failed[1:]:
        bad = bad.unionByName(frame)
    return named, bad


def run(spark: SparkSession, path: str, out: str, options: JobOptions = JobOptions(), embedder=None) -> None:
    """Process a folder and write the results in the chosen shape."""
    chunks, bad = process_folder(spark, path, options, embedder)
    embedded = embedder is not None and not options.skip_embedding  # and then written, see process_folder
    write_results(chunks, bad, out, options.response_format, "container_file", model_name=options.model_name, written=embedded)
