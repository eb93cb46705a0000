"""Chunks to results.

A file may hold a third of all chunks, so results come in parts: one row per file
and run of ``PART`` chunk indexes. No group is larger than that, and the parts of
a file in order are its whole result.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 1024

METADATA = [
    "source_file", "chunk_index", "token_count", "is_tabular", "table_type", "single_row", "row_split",
    "sentence_aware", "table_columns", "embedding_model_id", "row_data", "extra_metadata",
]


def part_of(chunk_index: str = "chunk_index", size: int = PART) -> Column:
    return F.floor(F.col(chunk_index) / size).cast("int").alias("part")


def chunk_result() -> Column:
    """A chunk as ``struct<text, metadata>`` (F1)."""
    return F.struct("text", F.struct(*METADATA).alias("metadata"))


def file_results(
    chunks: DataFrame, file: str = "source_file", size: int = PART, files: DataFrame | None = None
) -> DataFrame:
    """Nested results of each file in parts, chunks in order, vectors beside them (F2).

    ``file`` may name the container a member came from; the parts then run per
    member, whose chunk numbers start at zero. Files of ``files(filename, member)``
    without a chunk, as blank ones, have one part with an empty list.
    """
    keys = [F.col(file).alias("filename"), F.col("source_file").alias("member"), part_of(size=size)]
    vectors = "embedding" in chunks.columns
    entry = F.struct("chunk_index", chunk_result().alias("chunk"), *(["embedding"] if vectors else []))
    entries = chunks.select(*keys, entry.alias("_entry"))
    if files is not None:
        # Names join the grouping without an entry, which leaves the chunks to be made once.
        kind = entries.schema["_entry"].dataType
        entries = entries.union(files.select("filename", "member", F.lit(0).alias("part"), F.lit(None).cast(kind).alias("_entry")))
    grouped = entries.groupBy("filename", "member", "part").agg(F.array_sort(F.collect_list("_entry"), by_index).alias("_rows"))
    embeddings = F.col("_rows.embedding") if vectors else F.lit(None).cast("array<array<float>>")
    return grouped.select("filename", "member", "part", F.col("_rows.chunk").alias("chunks"), embeddings.alias("embeddings"))


def by_index(a: Column, b: Column) -> Column:
    return a["chunk_index"] - b["chunk_index"]


def with_errors(results: DataFrame, failed: DataFrame) -> DataFrame:
    """Good files and failed files in one result."""
    bad = failed.select(
        F.col("source_file").alias("filename"),
        F.struct("error_code", "message", "detail").alias("error"),
    )
    return results.unionByName(bad, allowMissingColumns=True)


def totals(
    chunks: DataFrame, failed: DataFrame | None = None, file: str = "source_file", files: DataFrame | None = None
) -> DataFrame:
    """Chunk and token counts per file, zero for a failed one and for one of ``files(filename)`` without chunks."""
    good = chunks.groupBy(F.col(file).alias("filename")).agg(
        F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens")
    )
    if files is not None:
        named = files.select("filename").distinct().join(good, "filename", "left")
        good = named.select(
            "filename", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_chunks", "total_tokens")]
        )
    if failed is None:
        return good
    bad = failed.select(
        F.col("source_file").alias("filename"), F.lit(0).cast("bigint").alias("total_chunks"), F.lit(0).cast("bigint").alias("total_tokens")
    )
    return good.unionByName(bad)


def grand_total(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.sum("token_count").cast("bigint").alias("total_tokens"))


def npy_matrices(chunks: DataFrame, file: str = "source_file", size: int = PART) -> DataFrame:
    """Vectors of each file as ``.npy`` matrices in chunk order, one per part.

    Spark collects and orders the vectors of a part; Python only puts the header
    in front, for many parts per Arrow batch.
    """

    @F.pandas_udf("binary")
    def npy(matrices: pd.Series) -> pd.Series:
        def one(vectors: np.ndarray) -> bytes:
            buffer = io.BytesIO()
            np.save(buffer, np.stack(vectors).astype(np.float32))
            return buffer.getvalue()

        return matrices.map(one)

    keys = [F.col(file).alias("filename"), F.col("source_file").alias("member"), part_of(size=size)]
    # Chunks without a vector are left out here: a filter before the grouping would compute the vectors a second time.
    rows = F.array_sort(F.collect_list(F.when(F.col("embedding").isNotNull(), F.struct("chunk_index", "embedding"))))
    grouped = chunks.groupBy(*keys).agg(rows.alias("_rows")).where(F.size("_rows") > 0)
    return grouped.select(
        "filename", "member", "part", F.size("_rows").alias("n_chunks"), npy(F.col("_rows.embedding")).alias("npy")
    )


def base64_matrices(chunks: DataFrame, file: str = "source_file", size: int = PART) -> DataFrame:
    """The matrices as base64 text without line breaks."""
    encoded = F.regexp_replace(F.base64("npy"), "[\r\n]", "")
    return npy_matrices(chunks, file, size).withColumn("embeddings_base64_npy", encoded).drop("npy")
