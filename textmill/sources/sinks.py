"""Writers (A13-A15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.results import base64_matrices, file_results, npy_matrices, totals, with_errors
from textmill.session import materialize


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Flat chunks as parquet."""
    chunks.write.mode(mode).parquet(path)


def write_results(
    chunks: DataFrame,
    failed: DataFrame,
    path: str,
    response_format: str = "json",
    file: str = "source_file",
    mode: str = "append",
    model_name: str | None = None,
    written: bool = False,
) -> None:
    """Nested results in one of the three result shapes.

    ``json`` puts the vectors into the records, ``json_with_embeddings`` a base64
    matrix per part, ``zip`` leaves them out of the records and writes the matrices
    beside them under the full file name. Records carry the totals of their file and
    the model's name. Totals, records and matrices read the chunks, which are written once
    before, unless they are ``written`` tables already.
    """
    if not written:
        chunks = materialize(chunks)

    def complete(records: DataFrame) -> DataFrame:
        counted = records.join(totals(chunks, file=file), "filename", "left")
        return with_errors(counted.withColumn("model_name", F.lit(model_name)), failed)

    if response_format == "json":
        complete(file_results(chunks, file)).write.mode(mode).json(path)
        return
    if response_format not in ("json_with_embeddings", "zip"):
        raise ValueError(f"unknown response format {response_format!r}")
    records = file_results(chunks.drop("embedding"), file).drop("embeddings")
    vectors = "embedding" in chunks.columns
    if response_format == "json_with_embeddings":
        if vectors:
            encoded = base64_matrices(chunks, file).select("filename", "member", "part", "embeddings_base64_npy")
            records = records.join(encoded, ["filename", "member", "part"], "left")
        complete(records).write.mode(mode).json(path)
        return
    complete(records).write.mode(mode).json(f"{path}/results")
    if vectors:
        npy_matrices(chunks, file).withColumn("npy_name", F.format_string("%s.%05d.npy", "member", "part")).write.mode(mode).parquet(
            f"{path}/matrices"
        )
