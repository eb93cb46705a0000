"""Incremental ingest (A12): the batch plans over a file stream.

``ingest`` appends the chunks of a stream of documents. ``ingest_folder`` takes files of all
kinds: every micro-batch runs the folder job over its own files, tables and archives included,
as a table's plan needs all of the table at once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textmill.functions.charset import decode_text
from textmill.operators.documents import chunk_documents
from textmill.options import JobOptions

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def stream_text(spark: SparkSession, path: str, options: JobOptions = JobOptions()) -> DataFrame:
    """Documents of the ``.txt`` files that arrive below ``path``; of any size unless a limit is set."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", "*.[tT][xX][tT]")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    if options.limits.max_file_bytes is not None:
        files = files.where(F.col("length") <= options.limits.max_file_bytes)
    return files.select(F.col("path").alias("source_file"), decode_text("content").alias("text"))


def _unglobbed(path: str) -> str:
    """A path that readers take as it is, whatever characters its name has."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the parquet table at ``path``, one file or a folder of files.

    A stream takes its path for a folder, which a single file is not, unless it is a pattern;
    one that only this name matches serves for both.
    """
    name = path.rstrip("/")
    schema = spark.read.parquet(_unglobbed(name)).schema
    return spark.readStream.schema(schema).parquet(f"{_unglobbed(name[:-1])}[{name[-1]}]")


def ingest(
    docs: DataFrame, path: str, checkpoint: str, options: JobOptions = JobOptions(), available_now: bool = True, keep: tuple[str, ...] = ()
) -> StreamingQuery:
    """Chunk a stream of documents and append the chunks to parquet.

    The plan is the batch plan: it holds no state, so a restart goes on from the
    checkpoint with the files not yet committed. ``checkpoint`` and ``path`` belong
    on storage every executor reaches.
    """
    writer = (
        chunk_documents(docs, options, *keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_folder(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    options: JobOptions = JobOptions(),
    embedder=None,
    available_now: bool = True,
    max_files: int = 1000,
) -> StreamingQuery:
    """Chunks and errors of all files that arrive below ``path``, as parquet in ``out/chunks`` and ``out/errors``.

    The stream hands on names, of at most ``max_files`` files a batch; the batch reads them as
    ``plans.corpus.process_folder`` does, large tables in splits. A batch writes to a folder of
    its own number and replaces what is there. A batch broken off after any of its writes runs
    again over the same files, which the checkpoint holds, and leaves every row once. A file is
    taken when it appears; one that changes later is not taken again.
    """
    from textmill.plans.corpus import process_folder

    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select("path")
    )

    def write(batch: DataFrame, number: int) -> None:
        names = [_unglobbed(r.path) for r in batch.collect()]  # at most max_files
        if not names:
            return
        chunks, bad = process_folder(batch.sparkSession, names, options, embedder)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
