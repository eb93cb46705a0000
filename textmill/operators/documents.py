"""Documents to chunks, and the text a document is put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill import errors
from textmill.functions.text import is_blank, normalize, strip
from textmill.operators.chunk_pack import pack_text
from textmill.options import JobOptions, Limits
from textmill.session import materialize


def chunk_columns(**given: Column) -> list[Column]:
    """The chunk schema with defaults for the fields a branch does not set."""
    defaults = {
        "is_tabular": F.lit(False),
        "table_type": F.lit(None).cast("string"),
        "single_row": F.lit(False),
        "row_split": F.lit(False),
        "sentence_aware": F.lit(False),
        "table_columns": F.lit(None).cast("array<string>"),
        "embedding_model_id": F.lit(None).cast("string"),
        "row_data": F.lit(None).cast("map<string,string>"),
        "extra_metadata": F.lit(None).cast("map<string,string>"),
    }
    names = ["text", "source_file", "chunk_index", "token_count", *defaults]
    return [given.get(n, defaults.get(n)).alias(n) for n in names]


def chunk_documents(docs: DataFrame, options: JobOptions = JobOptions(), *keep: str) -> DataFrame:
    """Normalize and chunk ``docs(source_file, text)``.

    Columns named in ``keep`` travel along with the chunks.
    """
    if options.chunk_mode == "exact":
        from textmill.operators.chunk_exact import chunk_exact

        prepared = docs.withColumn("text", normalize("text", options.normalization))
        chunks = chunk_exact(prepared, options.max_tokens, options.overlap, options.counter, *keep)
    else:
        packed = pack_text(normalize("text", options.normalization), options.max_tokens, options.overlap)
        chunks = docs.select("source_file", *keep, F.posexplode(packed).alias("chunk_index", "chunk")).select(
            "source_file", *keep, "chunk_index", "chunk.text", "chunk.token_count"
        )
    return chunks.select(
        *chunk_columns(
            text=F.col("text"),
            source_file=F.col("source_file"),
            chunk_index=F.col("chunk_index"),
            token_count=F.col("token_count"),
            sentence_aware=F.lit(True),
        ),
        *keep,
    )


ERROR = "source_file string, error_code string, message string, detail string"


def chunk_documents_checked(docs: DataFrame, options: JobOptions = JobOptions(), *keep: str) -> tuple[DataFrame, DataFrame]:
    """Chunks as of :func:`chunk_documents`, and the errors of documents that cannot be processed.

    Only exact mode runs Python, where a tokenizer may fail on a text. The walked
    chunks are written once, as both results read them.
    """
    spark = docs.sparkSession
    if options.chunk_mode != "exact":
        return chunk_documents(docs, options, *keep), spark.createDataFrame([], ERROR)
    from textmill.operators.chunk_exact import chunk_exact

    prepared = docs.withColumn("text", normalize("text", options.normalization))
    walked = materialize(chunk_exact(prepared, options.max_tokens, options.overlap, options.counter, *keep, failures=True))
    chunks = walked.where(F.col("failure").isNull()).select(
        *chunk_columns(
            text=F.col("text"),
            source_file=F.col("source_file"),
            chunk_index=F.col("chunk_index"),
            token_count=F.col("token_count"),
            sentence_aware=F.lit(True),
        ),
        *keep,
    )
    return chunks, errors.processing_errors(walked.where(F.col("failure").isNotNull()), F.col("failure"))


def within_limit(parts: DataFrame, key: str, text: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Parts of the documents within the file size limit, and the errors of the others.

    Run before the parts of a document are put together where a caller sets a limit. The sizes are summed before the shuffle, so a document with
    a third of all parts costs one row per task. Without a limit nothing is read.
    """
    none = parts.sparkSession.createDataFrame([], ERROR)
    if limits.max_file_bytes is None:
        return parts, none
    sizes = parts.groupBy(key).agg(F.sum(F.octet_length(text) + 1).alias("bytes"))
    big = materialize(sizes.where(F.col("bytes") > limits.max_file_bytes).select(key))
    name = F.col(key).cast("string")
    failed = big.select(
        name.alias("source_file"),
        F.lit(errors.FILE_TOO_LARGE).alias("error_code"),
        errors.file_too_large(name, limits.max_file_bytes).alias("message"),
        F.lit(None).cast("string").alias("detail"),
    )
    return parts.join(big, key, "left_anti"), failed


def page_concat(
    pages: DataFrame, key: str = "doc", order: str = "page_no", text: str = "text", limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """Non-empty page texts of a document joined by newlines (B10), and the errors."""
    filled, failed = within_limit(pages.where(F.col(text) != ""), key, text, limits)
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return filled.groupBy(key).agg(F.array_join(ordered[text], "\n").alias(text)), failed


def block_dedupe(
    blocks: DataFrame, key: str = "doc", kind: str = "kind", order: str = "ord", text: str = "text", limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame]:
    """Paragraphs as they are, then table cells on first occurrence only (B9), and the errors.

    A cell is dropped where its stripped text equals an earlier cell or an
    unstripped paragraph. Both rules are one array difference on the document's own
    blocks, which the size limit bounds.
    """
    filled, failed = within_limit(blocks.where(~is_blank(text)), key, text, limits)

    def texts(of: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(of, F.struct(order, text))))[text]

    is_cell = F.col(kind) == "cell"
    grouped = filled.groupBy(key).agg(texts(~is_cell).alias("_paragraphs"), texts(is_cell).alias("_cells"))
    cells = F.array_except(F.transform("_cells", strip), F.col("_paragraphs"))
    return grouped.select(key, F.array_join(F.concat("_paragraphs", cells), "\n").alias(text)), failed
