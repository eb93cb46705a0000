"""Table rows to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.columns import let
from textmill.functions.text import is_blank, strip
from textmill.operators.chunk_pack import in_blocks
from textmill.operators.documents import chunk_columns, chunk_documents, within_limit
from textmill.operators.layout import Layout, layout_of
from textmill.operators.ordering import BLK, WHOLE, block_of, running_totals, with_blocks
from textmill.operators.row_text import SEPARATOR, row_map, row_text
from textmill.operators.table_clean import source_profile, table_gate, table_profile, too_long_tables
from textmill.options import JobOptions
from textmill.session import materialize

SAMPLE_SIZE = 100  # Fixed value: rows measured for the ratio of a table.
FALLBACK_RATIO = 4.0  # Fixed value: characters per token of a table without text.
BUFFER = 1.1  # Fixed value: a row may exceed the estimate by this factor unsplit.


def table_type(extension: Column) -> Column:
    """Kind of table by file extension."""
    ext = F.lower(extension)
    return F.when(ext == ".csv", "csv").when(ext.isin(".xlsx", ".xls"), "excel").otherwise("table")


def _text_of(layout: Layout, options: JobOptions, kept: Column) -> Column:
    return row_text(
        layout,
        options.include_column_names,
        options.values_only_threshold,
        options.normalization,
        options.output_text_column,
        F.array_contains(kept, options.output_text_column) if options.output_text_column else None,
    )


def _by_column(options: JobOptions, single: str, joined: str) -> Column:
    """The value about the text column where the source has it, else the one about all cells."""
    if not options.output_text_column:
        return F.col(joined)
    return F.when(F.array_contains("kept", options.output_text_column), F.col(single)).otherwise(F.col(joined))


def _is_measured(n: Column) -> Column:
    """Whether the profile has the texts of a source measured, all of them being its sample."""
    return (F.col(BLK) == WHOLE) & (n <= SAMPLE_SIZE) & F.col("tokens_text").isNotNull()


def sample_blocks(profile: DataFrame, source: DataFrame, options: JobOptions) -> DataFrame:
    """Blocks holding sampled rows, with the rank of their first row and the sampling step.

    Rank ``k * step`` for k below the sample size is taken; a block is wanted when
    one of these ranks falls into it. At most one block per sampled row remains, and none
    of a source that the profile has measured.
    """
    n = _by_column(options, "n_single", "n_text")
    blocks = profile.join(source.select("source_file", "kept"), "source_file").where(~_is_measured(n))
    ranked = running_totals(blocks.select("source_file", BLK, "kept", n.alias("_n")), "source_file", "_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n_total") / SAMPLE_SIZE))
    first = F.ceil(F.col("_n_before") / F.col("_step"))
    return (
        ranked.withColumn("_step", step)
        .where((first < SAMPLE_SIZE) & (first * F.col("_step") < F.col("_n_before") + F.col("_n")))
        .select("source_file", BLK, "kept", "_step", F.col("_n_before").alias("_rank"))
    )


def char_token_ratio(rows: DataFrame, options: JobOptions, columns: list[str] | None = None) -> DataFrame:
    """Characters per token of each table from a systematic sample of its rows."""
    layout = layout_of(rows, columns)
    rows = with_blocks(rows)
    profile = table_profile(rows, layout, options)
    return _sampled_ratio(rows, layout, options, profile, source_profile(profile))


def _sampled_ratio(rows: DataFrame, layout: Layout, options: JobOptions, profile: DataFrame, source: DataFrame) -> DataFrame:
    # Written, so that no row is read where no block is wanted.
    wanted = materialize(sample_blocks(profile, source, options))
    local = Window.partitionBy("source_file", BLK).orderBy("row_idx")
    filled = layout.has_text()
    if options.output_text_column:
        name = options.output_text_column
        filled = F.when(F.array_contains("kept", name), ~is_blank(layout.cell(name))).otherwise(filled)
    sampled = (
        rows.join(wanted, ["source_file", BLK])
        .where(filled)
        .withColumn("_rank", F.col("_rank") + F.row_number().over(local) - 1)
        .where((F.col("_rank") % F.col("_step") == 0) & (F.col("_rank") / F.col("_step") < SAMPLE_SIZE))
        .select("source_file", _text_of(layout, options, F.col("kept")).alias("_text"))
    )
    measured = sampled.groupBy("source_file").agg(
        F.sum(F.length("_text")).alias("chars"), F.sum(options.counter.count("_text")).alias("tokens")
    )
    n = _by_column(options, "n_single", "n_text")
    small = profile.join(source.select("source_file", "kept"), "source_file").where(_is_measured(n))
    chars, tokens = _by_column(options, "chars_single", "chars_text"), _by_column(options, "tokens_single", "tokens_text")
    sums = measured.unionByName(small.select("source_file", chars.alias("chars"), tokens.alias("tokens")))
    known = sums.select("source_file", (F.col("chars") / F.col("tokens")).alias("ratio"))
    return (
        source.select("source_file")
        .join(known, "source_file", "left")
        .select("source_file", F.coalesce("ratio", F.lit(FALLBACK_RATIO)).alias("ratio"))
    )


def context_prefix(row: Column, chars_per_chunk: Column, include_names: bool) -> Column:
    """Short cells of a row as the context put before its later segments.

    A cell may take a third of a chunk, the prefix a quarter; the prefix stops at
    the first cell that would overflow it.
    """
    third, cap = F.floor(chars_per_chunk / 3), F.floor(chars_per_chunk / 4)
    stripped = F.transform(row, lambda c: F.struct(c["name"].alias("name"), strip(c["val"]).alias("val")))
    short = F.filter(stripped, lambda c: (c["val"] != "") & (F.length(c["val"]) <= third))
    parts = F.transform(short, lambda c: F.concat(c["name"], F.lit(": "), c["val"]) if include_names else c["val"])

    def add(a: Column, part: Column) -> Column:
        return F.when(
            a["open"] & (F.length(a["text"]) + F.length(part) + len(SEPARATOR) <= cap),
            F.struct(F.concat(a["text"], part, F.lit(SEPARATOR)).alias("text"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["text"].alias("text"), F.lit(False).alias("open")))

    return F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit(True).alias("open")), add, lambda a: a["text"])


def split_row(text: Column, prefix: Column, chars_per_chunk: Column) -> Column:
    """Windows of a long row's text, each ending after its last space.

    Two consecutive windows advance at least by the size of a later window, which
    bounds the number of steps; a finished state passes through unchanged. Windows are
    gathered in runs, so that no array grows over the whole row.
    """

    def cut(v: Column) -> Column:
        t, cpc, pre = v["t"], v["cpc"], v["pre"]
        later = F.greatest(F.lit(1), cpc - F.length(pre), F.floor(cpc / 2).cast("int"))

        def step(a: Column, _: Column) -> Column:
            def advance(w: Column) -> Column:
                space = F.instr(F.reverse(w), " ")
                k = F.when(
                    (a["pos"] + F.length(w) < F.length(t)) & (space > 0) & (space < F.length(w)),
                    F.length(w) - space + 1,
                ).otherwise(F.length(w))
                return let(
                    k,
                    lambda n: F.struct(
                        (a["pos"] + n).alias("pos"),
                        F.array_append(a["out"], strip(F.substring(w, F.lit(1), n))).alias("out"),
                    ),
                )

            size = F.when(a["pos"] == 0, cpc).otherwise(later)
            return F.when(a["pos"] >= F.length(t), a).otherwise(let(F.substring(t, a["pos"] + 1, size), advance))

        def run(a: Column, steps: Column) -> Column:
            own = F.struct(a["pos"].alias("pos"), F.array().cast("array<string>").alias("out"))
            return let(
                F.aggregate(steps, own, step),
                lambda s: F.struct(s["pos"].alias("pos"), F.array_append(a["all"], s["out"]).alias("all")),
            )

        bound = (2 * F.ceil(F.length(t) / later) + 2).cast("int")
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<string>>").alias("all"))
        windows = F.aggregate(in_blocks(F.sequence(F.lit(1), bound)), start, run, lambda a: F.flatten(a["all"]))
        pieces = F.filter(windows, lambda s: s != "")
        return F.transform(pieces, lambda s, i: F.when(i > 0, F.concat(pre, s)).otherwise(s))

    return let(F.struct(text.alias("t"), prefix.alias("pre"), chars_per_chunk.alias("cpc")), cut)


def _estimate(length: Column, ratio: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(length / ratio)).cast("int")


def fits_in_one(length: Column, ratio: Column, max_tokens: int) -> Column:
    """Whether a row text of this length stays in one piece (D11); shorter ones then do too."""
    return (length <= F.floor(F.lit(max_tokens) * ratio * BUFFER)) | (_estimate(length, ratio) <= max_tokens)


def row_segments(text: Column, row: Column, ratio: Column, options: JobOptions) -> Column:
    """Chunks of one row as ``array<struct<text, token_count, row_split>>``.

    Sizes are estimated through the ratio; only over-long rows are split.
    """
    per_chunk = F.greatest(F.lit(1), F.floor(F.lit(options.max_tokens) * ratio)).cast("int")
    prefix = context_prefix(row, per_chunk, options.include_column_names) if options.attach_context_on_split else F.lit("")

    def segment(t: Column, was_split: bool) -> Column:
        tokens = _estimate(F.length(t), ratio)
        return F.struct(t.alias("text"), tokens.alias("token_count"), F.lit(was_split).alias("row_split"))

    return (
        F.when(text == "", F.array().cast("array<struct<text:string,token_count:int,row_split:boolean>>"))
        .when(fits_in_one(F.length(text), ratio, options.max_tokens), F.array(segment(text, False)))
        .otherwise(F.transform(split_row(text, prefix, per_chunk), lambda t: segment(t, True)))
    )


def chunk_rows(
    rows: DataFrame, options: JobOptions = JobOptions(), extension: str = ".csv", columns: list[str] | None = None
) -> DataFrame:
    """Rows of tables to chunks with dense indexes per source (D3-D18, without the gate).

    ``rows`` holds ``source_file``, ``row_idx`` (a position, unique per source) and
    the cells. Narrow passes find the used columns, the ratio and, where rows are
    too long for one chunk, the number of segments per block of rows; the last pass
    shuffles the rows once, by source and block, and numbers them.
    """
    layout = layout_of(rows, columns)
    rows = with_blocks(rows)
    profile = table_profile(rows, layout, options)
    return _chunk_profiled(rows, layout, options, extension, profile, source_profile(profile))


def _chunk_profiled(
    rows: DataFrame, layout: Layout, options: JobOptions, extension: str, profile: DataFrame, source: DataFrame
) -> DataFrame:
    ratio = _sampled_ratio(rows, layout, options, profile, source)
    # Written, as the sample would be drawn again for the second of its uses.
    facts = materialize(source.select("source_file", "kept").join(ratio, "source_file"))
    blocks = profile.join(facts, "source_file").select(
        "source_file",
        BLK,
        "kept",
        "ratio",
        _by_column(options, "n_single", "n_text").alias("_n"),
        _by_column(options, "longest_single", "longest_text").alias("_longest"),
    )
    blocked = rows.where(layout.has_text())
    kept_cells = F.filter(layout.cells(), lambda c: F.array_contains(F.col("kept"), c["name"]))
    text = _text_of(layout, options, F.col("kept"))
    pieces = row_segments(F.col("_text"), kept_cells, F.col("ratio"), options)

    def cut(known: DataFrame) -> DataFrame:
        return blocked.join(known, ["source_file", BLK]).withColumn("_text", text).withColumn("_segments", pieces)

    # A block without an over-long row has as many segments as rows with text; only the rows of
    # other blocks are cut for counting; their list is written, so that none is read where it is empty.
    counts = blocks.select("source_file", BLK, "kept", "ratio", "_n")
    over = blocks.where(~fits_in_one(F.col("_longest"), F.col("ratio"), options.max_tokens))
    long = materialize(over.select("source_file", BLK, "kept", "ratio"))
    found = cut(long).groupBy("source_file", BLK).agg(
        F.sum(F.size("_segments")).alias("_cut")
    )
    counts = counts.join(found, ["source_file", BLK], "left").withColumn("_n", F.coalesce("_cut", "_n")).drop("_cut")
    numbered = materialize(running_totals(counts, "source_file", "_n").select("source_file", BLK, "kept", "ratio", "_n_before"))

    before = Window.partitionBy("source_file", BLK).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    attach = options.attach_row_data or options.flatten_row_values_to_root
    segments = cut(numbered)
    exploded = segments.withColumn(
        "_base", F.col("_n_before") + F.coalesce(F.sum(F.size("_segments")).over(before), F.lit(0))
    ).select(
        "source_file",
        "row_idx",
        "kept",
        "_base",
        *([row_map(layout, F.col("kept")).alias("_row")] if attach else []),
        F.posexplode("_segments").alias("_pos", "_segment"),
    )
    none = F.lit(None).cast("map<string,string>")
    return exploded.select(
        *chunk_columns(
            text=F.col("_segment.text"),
            source_file=F.col("source_file"),
            chunk_index=(F.col("_base") + F.col("_pos")).cast("int"),
            token_count=F.col("_segment.token_count"),
            is_tabular=F.lit(True),
            table_type=table_type(F.lit(extension)),
            single_row=~F.col("_segment.row_split"),
            row_split=F.col("_segment.row_split"),
            table_columns=F.col("kept"),
            row_data=F.col("_row") if options.attach_row_data else none,
            extra_metadata=F.col("_row") if options.flatten_row_values_to_root else none,
        ),
        "row_idx",
    )


def fallback_chunks(rows: DataFrame, layout: Layout, options: JobOptions) -> tuple[DataFrame, DataFrame]:
    """Chunks of the tables that fail the gate, read as plain text, header first (D14), and the errors.

    Blank cells stay in. A text is put together per block of rows, so that a table of
    any length stays in pieces; its chunks end at the border of a block, and their
    numbers go on behind those of the blocks before. ``rows`` hold their block and
    in ``_n_before`` the number of the source's rows in blocks before it.
    """
    lines = rows.select(
        "source_file",
        "row_idx",
        BLK,
        "_n_before",
        layout.line(SEPARATOR).alias("line"),
        F.array_join(layout.header(), SEPARATOR).alias("header"),
    )
    fitting, too_big = within_limit(lines, "source_file", "line", options.limits)
    ordered = F.array_sort(F.collect_list(F.struct("row_idx", "line")))
    # Blocks of positions, as row ids may be sparse.
    local = Window.partitionBy("source_file", BLK).orderBy("row_idx")
    placed = fitting.withColumn("_pos", F.col("_n_before") + F.row_number().over(local) - 1).drop(BLK, "_n_before")
    texts = placed.groupBy("source_file", block_of("_pos").alias(BLK)).agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("_lines"), F.any_value("header").alias("_header")
    )
    first = texts.groupBy("source_file").agg(F.min(BLK).alias("_first"))
    headed = F.when(F.col(BLK) == F.col("_first"), F.concat("_header", F.lit("\n"), "_lines")).otherwise(F.col("_lines"))
    whole = texts.join(first, "source_file").select("source_file", BLK, headed.alias("text"))
    chunks = chunk_documents(whole, options, BLK)
    counts = chunks.groupBy("source_file", BLK).agg(F.count("*").alias("_n"))
    before = running_totals(counts, "source_file", "_n").select("source_file", BLK, "_n_before")
    numbered = chunks.join(before, ["source_file", BLK])
    index = (F.col("chunk_index") + F.col("_n_before")).cast("int")
    return numbered.withColumn("chunk_index", index).drop(BLK, "_n_before").select(*chunks.drop(BLK).columns), too_big


def chunk_tables(
    rows: DataFrame, options: JobOptions = JobOptions(), extension: str = ".csv", columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tables to chunks with the gate and the row cap (D1-D18), and the errors."""
    layout = layout_of(rows, columns)
    rows = with_blocks(rows)
    profile = table_profile(rows, layout, options)
    whole = source_profile(profile)
    most = options.limits.max_table_rows
    within = whole if most is None else whole.where(F.col("n_rows") <= most)
    gated = table_gate(within, options.min_cols_for_table, options.min_rows_for_table)
    failed = too_long_tables(whole, options.limits)
    tables = gated.where("is_table")
    # The verdict reaches the rows per block, so a hot table does not skew the join. Written with the
    # positions at which the blocks begin, as the profile has counted their rows.
    refused = profile.select("source_file", BLK, "n_rows").join(gated.where(~F.col("is_table")).select("source_file"), "source_file")
    begins = running_totals(refused, "source_file", "n_rows").select("source_file", BLK, F.col("n_rows_before").alias("_n_before"))
    begins = materialize(begins)
    table_blocks = profile.join(tables.select("source_file"), "source_file", "left_semi")
    as_tables = _chunk_profiled(rows, layout, options, extension, table_blocks, tables)
    as_text, too_big = fallback_chunks(rows.join(begins, ["source_file", BLK]), layout, options)
    as_text = as_text.withColumn("row_idx", F.lit(None).cast("bigint"))
    return as_tables.unionByName(as_text), failed.unionByName(too_big)
