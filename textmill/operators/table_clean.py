"""Table profile, gate, caps and cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill import errors
from textmill.functions.text import fold_case, is_blank, strip
from textmill.operators.documents import ERROR
from textmill.operators.layout import Layout, layout_of
from textmill.operators.ordering import BLK, WHOLE, block_of, dense_index, with_blocks
from textmill.operators.row_text import row_text
from textmill.options import JobOptions, Limits
from textmill.session import materialize

SPARSE_RUN = 50  # Fixed value: consecutive sparse rows that end a sheet.
MIN_FILLED = 2  # Fixed value: filled cells a row needs to count.


def table_profile(rows: DataFrame, layout: Layout, options: JobOptions = JobOptions()) -> DataFrame:
    """Row counts, used columns and longest texts per ``(source, block)`` in one narrow pass.

    Feeds the gate, the row cap, the column cleanup, the ratio sample and the
    numbering of the chunks. The result has one row per few thousand input rows; it
    is written once, so the input is not read again for each of them. ``n_single``
    and ``longest_single`` are about the cells of ``output_text_column`` alone. Of a source
    that is one block the texts are measured here, if the counter is an expression.
    """
    joined = row_text(layout, options.include_column_names, options.values_only_threshold, options.normalization)
    column = options.output_text_column
    single = strip(fold_case(layout.cell(column), options.normalization)) if column else F.lit("")
    filled = ~is_blank(layout.cell(column)) if column else F.lit(False)
    texts = with_blocks(rows).withColumns({"_joined": joined, "_single": single, "_has_text": layout.has_text(), "_filled": filled})
    measured = (F.col(BLK) == WHOLE) & F.lit(options.counter.additive)

    def sums(name: str, text: str, of: Column) -> list[Column]:
        length = F.when(measured & of, F.length(text))
        tokens = F.when(measured & of, options.counter.count(text)) if options.counter.additive else F.lit(None).cast("int")
        return [F.sum(length).alias(f"chars_{name}"), F.sum(tokens).alias(f"tokens_{name}")]

    counted = texts.groupBy("source_file", BLK).agg(
        F.count("*").alias("n_rows"),
        F.count_if("_has_text").alias("n_text"),
        F.count_if(F.col("_single") != "").alias("n_single"),
        F.max(F.length("_joined")).alias("longest_text"),
        F.max(F.length("_single")).alias("longest_single"),
        *sums("text", "_joined", F.col("_has_text")),
        *sums("single", "_single", F.col("_filled")),
        *layout.headers(),
        *layout.used(),
    )
    counts = ["n_rows", "n_text", "n_single", "longest_text", "longest_single"]
    counts += ["chars_text", "tokens_text", "chars_single", "tokens_single"]
    return materialize(counted.select("source_file", BLK, *counts, layout.header_of().alias("header"), layout.used_names().alias("used")))


def source_profile(profile: DataFrame) -> DataFrame:
    """The block profile rolled up: rows, text rows, header and kept columns per source (D3)."""
    counts = profile.groupBy("source_file").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_text").alias("n_text"), F.any_value("header").alias("header")
    )
    # Distinct before collecting: a set is never larger than the header.
    used = profile.select("source_file", F.explode("used").alias("name")).distinct()
    names = used.groupBy("source_file").agg(F.collect_set("name").alias("_names"))
    kept = F.filter("header", lambda h: F.array_contains(F.coalesce("_names", F.array().cast("array<string>")), h))
    return materialize(
        counts.join(names, "source_file", "left").select("source_file", "n_rows", "n_text", "header", kept.alias("kept"))
    )


def drop_null_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop the columns of a one-table frame that hold no value at all (D3).

    One aggregation returns a single row of counts; the schema must be known
    before the plan is built.
    """
    names = layout_of(df, columns).names
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(names)]).first()
    return df.drop(*[c for i, c in enumerate(names) if counts[i] == 0])


def drop_blank_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows without any text."""
    return df.where(layout_of(df, columns).has_text())


def table_gate(source: DataFrame, min_cols: int | None, min_rows: int | None) -> DataFrame:
    """Mark the sources too narrow or too short to be a table (D2), before any cleanup."""
    narrow = F.size("header") < min_cols if min_cols is not None else F.lit(False)
    short = F.col("n_rows") < min_rows if min_rows is not None else F.lit(False)
    return source.withColumn("is_table", ~(narrow | short))


def too_long_tables(source: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Error records of the sources over the row cap (A7); none where no cap is set."""
    name = F.col("source_file")
    if limits.max_table_rows is None:
        return source.sparkSession.createDataFrame([], ERROR)
    return source.where(F.col("n_rows") > limits.max_table_rows).select(
        name,
        F.lit(errors.TOO_MANY_ROWS).alias("error_code"),
        errors.too_many_rows(name, F.col("n_rows"), limits.max_table_rows).alias("message"),
        F.lit(None).cast("string").alias("detail"),
    )


def by_block(blocks: DataFrame, scalars: DataFrame) -> DataFrame:
    """Per-source values on every block of the source, ready for a join that does not skew."""
    return blocks.select("source_file", BLK).join(scalars, "source_file")


def row_cap(rows: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Rows of the tables within the cap, and the errors of the others.

    The verdict is joined per block, so a hot table is spread over the cluster. Without
    a cap all rows stay and nothing is read.
    """
    if limits.max_table_rows is None:
        return rows, rows.sparkSession.createDataFrame([], ERROR)
    blocked = with_blocks(rows)
    counts = materialize(blocked.groupBy("source_file", BLK).agg(F.count("*").alias("n_rows")))
    source = counts.groupBy("source_file").agg(F.sum("n_rows").alias("n_rows"))
    refused = materialize(by_block(counts, source.where(F.col("n_rows") > limits.max_table_rows).select("source_file")))
    return blocked.join(refused, ["source_file", BLK], "left_anti").drop(BLK), too_long_tables(source, limits)


def sparse_cut(flags: DataFrame, run: int) -> DataFrame:
    """The ``row_idx`` of the row that ends each source, for ``flags(source_file, row_idx, sparse)``.

    A row ends the sheet when it and the ``run - 1`` rows before it are all sparse.
    That needs no running group over the table: each block sees the last rows of
    the block before it.
    """
    placed = dense_index(flags, "source_file", "row_idx", "_pos")
    # A run may be longer than a block; its rows then show in all blocks it can end in.
    halo = F.sequence(block_of("_pos"), block_of(F.col("_pos") + (run - 1)))
    back = Window.partitionBy("source_file", BLK).orderBy("_pos").rowsBetween(-(run - 1), 0)
    return (
        placed.select("source_file", "row_idx", "_pos", "sparse", F.explode(halo).alias(BLK))
        .withColumn("_run", F.sum(F.col("sparse").cast("int")).over(back))
        .where(F.col("_run") == run)
        .groupBy("source_file")
        .agg(F.min("row_idx").alias("cut"))
    )


def cut_sparse_rows(
    rows: DataFrame, columns: list[str] | None = None, run: int = SPARSE_RUN, min_filled: int = MIN_FILLED
) -> DataFrame:
    """Drop sparse rows, and everything from the ``run``-th consecutive one on.

    Only ids and flags are ordered to find the cut; the rows themselves are then
    filtered in place.
    """
    flagged = rows.withColumn(BLK, block_of("row_idx")).withColumn(
        "sparse", layout_of(rows, columns).filled() < min_filled
    )
    cut = sparse_cut(flagged.select("source_file", "row_idx", "sparse"), run)
    blocks = flagged.select("source_file", BLK).distinct()
    verdict = by_block(blocks, cut)
    return (
        flagged.where(~F.col("sparse"))
        .join(verdict, ["source_file", BLK], "left")
        .where(F.col("cut").isNull() | (F.col("row_idx") < F.col("cut")))
        .select(*rows.columns)
    )
