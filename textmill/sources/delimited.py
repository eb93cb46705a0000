"""Delimited files of any size and any header, in splits (A4, A5).

All files share one plan. Their physical lines are read in splits; whether a line starts inside
a quoted cell follows from the number of quotes before it in its file, a running total over
blocks of lines, and the pieces of a record that spans lines are put together again, wherever
splits and blocks end. Encoding, delimiter and header are facts per file that reach the lines
by a join, so that files need not be told apart on the driver: ``fields`` and the other rules are
those of files read as one value.

Files with a UTF-16 mark are the exception: a byte of a line break can be half of another
character there, so each is read as one value, of at most 2 GB.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.charset import UNDEFINED_1254, decode_table, differences
from textmill.operators.ordering import BLK, block_of, running_totals
from textmill.session import materialize
from textmill.sources.fields import DELIMITERS, QUOTED, column_names, cut_rows, fields

CELLS = "array<struct<name:string,val:string>>"
LATIN = "ISO-8859-1"
UTF16_MARKS = ("FEFF", "FFFE")


def _unquoted(line: Column) -> Column:
    return F.regexp_replace(line, QUOTED, "")


def _occurrences(line: Column, sep: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit("")))


def delimiter_profile(lines: DataFrame, key: str = "source_file", line: str = "line") -> DataFrame:
    """The delimiter of each source (A5): ``(key, sep, n_fields, share)``.

    The delimiter that cuts the largest share of lines into the same number of
    fields wins; ties go to more fields, then to the order of preference. A source
    without any of them is comma-separated. The lines are counted by pattern before
    the shuffle, so a long file costs a few rows per task.
    """
    counts = [_occurrences(_unquoted(F.col(line)), s).alias(f"_c{i}") for i, s in enumerate(DELIMITERS)]
    patterns = lines.where(F.col(line) != "").select(key, *counts).groupBy(key, *[f"_c{i}" for i in range(len(DELIMITERS))]).agg(
        F.count("*").alias("_lines")
    )
    options = F.explode(
        F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"_c{i}").alias("hits")) for i in range(len(DELIMITERS))])
    )
    per_option = (
        patterns.select(key, "_lines", options.alias("o"))
        .groupBy(key, "o.rank", "o.hits")
        .agg(F.sum("_lines").alias("_lines"))
        .groupBy(key, "rank")
        .agg(
            F.sum("_lines").alias("_all"),
            F.max(F.when(F.col("hits") > 0, F.struct("_lines", "hits"))).alias("_mode"),
        )
    )
    best = F.max(
        F.when(
            F.col("_mode").isNotNull(),
            F.struct(F.col("_mode._lines").alias("lines"), F.col("_mode.hits").alias("hits"), (-F.col("rank")).alias("pref")),
        )
    )
    chosen = per_option.groupBy(key).agg(best.alias("_best"), F.max("_all").alias("_all"))
    seps = F.array(*[F.lit(s) for s in DELIMITERS])
    return chosen.select(
        key,
        F.element_at(seps, 1 - F.coalesce("_best.pref", F.lit(0))).alias("sep"),
        (F.coalesce("_best.hits", F.lit(0)) + 1).cast("int").alias("n_fields"),
        F.coalesce(F.col("_best.lines") / F.col("_all"), F.lit(0.0)).alias("share"),
    )


def _path(encoded: Column) -> Column:
    """A file's path as it is; the metadata column has it as a URL."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def _as_latin(text: Column, latin: Column) -> Column:
    """The bytes of a line as Latin-1."""
    return F.when(latin, text).otherwise(F.decode(text.cast("binary"), LATIN))


def _pieces(lines: DataFrame, position: Column) -> DataFrame:
    """``(source_file, pos, text, glue, latin, quotes)`` of lines between line feeds, cut at carriage returns too.

    ``glue`` is the break that ended a piece. A line that is not UTF-8 is held as Latin-1.
    ``position`` is taken where the pieces are made, in the order of the file.
    """
    latin = ~F.is_valid_utf8("value")
    line = F.when(latin, F.decode(F.col("value").cast("binary"), LATIN)).otherwise(F.col("value"))
    held = lines.select("source_file", "start", latin.alias("latin"), line.alias("line"))
    ends = F.col("line").endswith("\r")
    body = F.when(ends, F.left("line", F.length("line") - 1)).otherwise(F.col("line"))
    parts = F.when(F.contains(body, F.lit("\r")), F.split(body, "\r", -1)).otherwise(F.array(body))
    last = F.when(ends, "\r\n").otherwise("\n")
    cut = held.select("source_file", "start", "latin", last.alias("last"), F.size(parts).alias("n"), F.posexplode(parts).alias("i", "text"))
    glue = F.when(F.col("i") + 1 < F.col("n"), "\r").otherwise(F.col("last"))
    quotes = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    placed = cut.select("source_file", position.alias("pos"), "text", glue.alias("glue"), "latin", quotes.alias("quotes"))
    return placed.withColumn(BLK, block_of("pos"))


def _lines(spark: SparkSession, paths: list[str], glob: str | None, max_bytes: int | None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    text = (reader.option("pathGlobFilter", glob) if glob else reader).text(paths)
    if max_bytes is not None:
        text = text.where(F.col("_metadata.file_size") <= max_bytes)
    named = text.select(_path(F.col("_metadata.file_path")).alias("source_file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # A piece has at least one byte with its break, so that positions rise along the file and are unique in it.
    return _pieces(named, F.col("start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def _values(spark: SparkSession, paths: list[str], encoding: str | None) -> DataFrame:
    """Pieces of files read as one value each."""
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(escaped)
    text = F.regexp_replace(F.decode("content", encoding), "\\A\uFEFF", "") if encoding else decode_table("content")
    held = whole.select(F.col("path").alias("source_file"), text.alias("text"))
    # The pieces of a line take as many places as any line of the file may need.
    places = F.regexp_count("text", F.lit("\r(?!\n)")).cast("bigint") + 1
    lines = held.select("source_file", places.alias("places"), F.posexplode(F.split("text", "\n", -1)).alias("start", "value"))
    lines = lines.withColumn("start", F.col("start") * F.col("places"))
    return _pieces(lines, F.col("start") + F.col("i"))


def _blocks(pieces: DataFrame) -> DataFrame:
    """Facts per block of pieces, written: a row per some thousand lines."""
    wide = F.octet_length("text") > F.length("text")
    undefined = wide & _as_latin(F.col("text"), F.col("latin")).rlike(UNDEFINED_1254)
    mark = F.hex(F.substring(F.when(F.col("latin"), F.encode("text", LATIN)).otherwise(F.col("text").cast("binary")), 1, 2))
    return materialize(
        pieces.groupBy("source_file", BLK).agg(
            F.min(~F.col("latin")).alias("utf8"),
            F.max(undefined).alias("undefined"),
            F.max(F.col("quotes") % 2).alias("odd"),
            F.min_by(mark, "pos").alias("mark"),
            F.min("pos").alias("first"),
        )
    )


def _files(blocks: DataFrame) -> DataFrame:
    """Facts per file: its encoding, whether a record of it may span lines, its mark and first position."""
    code = F.when(F.min("utf8"), "utf8").when(F.max("undefined"), "iso8859_9").otherwise("cp1254")
    return blocks.groupBy("source_file").agg(
        code.alias("code"), (F.max("odd") > 0).alias("spans"), F.min_by("mark", BLK).alias("mark"), F.min("first").alias("first")
    )


def _decoded(codec: str | None) -> Column:
    """The text of a piece in the encoding of its file."""
    latin = _as_latin(F.col("text"), F.col("latin"))
    if codec:
        return F.translate(latin, *differences(codec))
    text = F.when(F.col("code") == "utf8", F.col("text"))
    for name in ("cp1254", "iso8859_9"):
        text = text.when(F.col("code") == name, F.translate(latin, *differences(name)))
    return text


def _spanning(pieces: DataFrame, facts: DataFrame) -> DataFrame:
    """``(source_file, pos, text)`` of the records of files in which cells may hold line breaks.

    Per block and for either state at its start, the last piece that begins a record is known
    without the blocks before; running totals over the blocks give the state, and with it where
    the record begun in earlier blocks lies. The text moves once by block and once by record.
    """
    in_block = Window.partitionBy("source_file", BLK).orderBy("pos")
    before = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    light = pieces.join(facts.select("source_file", BLK), ["source_file", BLK], "left_semi").select("source_file", BLK, "pos", "quotes")
    counted = light.withColumn("c", before).withColumn("all", F.sum("quotes").over(Window.partitionBy("source_file", BLK)))
    summary = materialize(
        counted.groupBy("source_file", BLK).agg(
            F.sum("quotes").alias("q"),
            F.max(F.when(F.col("c") % 2 == 0, F.col("pos"))).alias("even"),
            F.max(F.when(F.col("c") % 2 == 1, F.col("pos"))).alias("odd"),
            F.max(F.when(F.col("c") == F.col("all"), F.col("pos"))).alias("tail"),
        )
    )
    state = running_totals(summary, "source_file", "q")
    last = F.when(F.col("q_before") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    last = F.greatest(last, F.when(F.col("q_before") + F.col("q") == F.col("q_total"), F.col("tail")))
    # A row per block: few enough to go in order through one task per file.
    earlier = Window.partitionBy("source_file").orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    state = state.select("source_file", BLK, "q_before", "q_total", F.max(last).over(earlier).alias("open"))
    own = pieces.join(facts, ["source_file", BLK]).select("source_file", BLK, "pos", "glue", "quotes", "decoded" if "decoded" in pieces.columns else _decoded(None).alias("decoded"))
    inside = own.join(state, ["source_file", BLK]).withColumn("c", F.col("q_before") + before)
    # After all quotes of the file nothing is inside: a last one without its second is a plain character.
    begins = (F.col("c") % 2 == 0) | (F.col("c") == F.col("q_total"))
    begun = F.max(F.when(begins, F.col("pos"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.struct("pos", "decoded", "glue")))
    grouped = inside.withColumn("record", F.coalesce(begun, F.col("open"))).groupBy("source_file", "record").agg(parts.alias("parts"))
    glued = F.transform("parts", lambda p, i: F.concat(p["decoded"], F.when(i + 1 < F.size("parts"), p["glue"]).otherwise("")))
    return grouped.select("source_file", F.col("record").alias("pos"), F.array_join(glued, "").alias("text"))


def _records(pieces: DataFrame, blocks: DataFrame, files: DataFrame, codec: str | None) -> DataFrame:
    """``(source_file, pos, line)`` of all records that are not empty."""
    facts = blocks.select("source_file", BLK).join(files, "source_file")
    decoded = _decoded(codec).alias("text")
    single = pieces.join(facts.where(~F.col("spans")), ["source_file", BLK]).select("source_file", "pos", decoded)
    own = pieces if codec is None else pieces.withColumn("decoded", _decoded(codec))
    spanning = _spanning(own, facts.where("spans"))
    joined = single.union(spanning).withColumn(BLK, block_of("pos")).join(facts.select("source_file", BLK, "first"), ["source_file", BLK])
    plain = F.replace("text", F.lit("\x00"), F.lit(""))
    line = F.when(F.col("pos") == F.col("first"), F.regexp_replace(plain, "\\A\uFEFF", "")).otherwise(plain)
    return joined.select("source_file", "pos", line.alias("line")).where(F.col("line") != "")


def _read(
    spark: SparkSession, path: str | list[str], sep: str | None, encoding: str | None, glob: str | None, max_bytes: int | None
) -> tuple[DataFrame, DataFrame]:
    """Rows as cells, and the column names of each file."""
    paths = [path] if isinstance(path, str) else path
    wide = (encoding or "").upper().replace("_", "-").startswith("UTF-16")
    codec = None if encoding is None or wide or encoding.upper().replace("_", "-") == "UTF-8" else encoding
    if wide:
        pieces = _values(spark, paths, encoding)
        blocks = _blocks(pieces)
    else:
        pieces = _lines(spark, paths, glob, max_bytes)
        blocks = _blocks(pieces)
        marked = _files(blocks).where(F.col("mark").isin(*UTF16_MARKS)).select("source_file") if encoding is None else None
        names = [r.source_file for r in marked.collect()] if marked is not None else []
        if names:
            of_values = _values(spark, names, None)
            pieces = pieces.join(marked, "source_file", "left_anti").unionByName(of_values)
            blocks = blocks.join(marked, "source_file", "left_anti").unionByName(_blocks(of_values))
    files = _files(blocks)
    if encoding is not None and codec is None:
        files = files.withColumn("code", F.lit("utf8"))
    found = materialize(_records(pieces, blocks, files, codec))
    heads = found.groupBy("source_file").agg(F.min_by("line", "pos").alias("head"), F.min("pos").alias("at"))
    chosen = delimiter_profile(found).select("source_file", "sep") if sep is None else heads.select("source_file", F.lit(sep).alias("sep"))
    tables = materialize(heads.join(chosen, "source_file").select("source_file", "at", "sep", column_names(fields(F.col("head"), F.col("sep"))).alias("names")))
    placed = found.withColumn(BLK, block_of("pos"))
    known = blocks.select("source_file", BLK).join(tables, "source_file")
    rows = placed.join(known, ["source_file", BLK]).where("pos > at")
    renamed = rows.select(
        "source_file", F.col("pos").alias("row_idx"), F.col("line").alias("_record"), F.col("sep").alias("_sep"), F.col("names").alias("_names")
    )
    return cut_rows(renamed), tables


def read_delimited_cells(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    encoding: str | None = None,
    glob: str | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """``(source_file, row_idx, cells)`` of delimited files, each with the columns of its own file (A4, A5).

    Every file is read by its own header and delimiter, is named by its path and may have any
    size; cells may hold line breaks. Text that is not UTF-8 is windows-1254 or iso-8859-9
    unless ``encoding`` (UTF-8, UTF-16 or a codec of one byte) is given. Cells stay text. A record with
    too many fields is skipped, one with too few is padded with nulls; missing-value spellings
    become null and rows without any value go. ``glob`` and ``max_bytes`` leave files out by name
    and size. ``row_idx`` rises along a file and is unique in it.
    """
    if not path:
        return spark.createDataFrame([], f"source_file string, row_idx bigint, cells {CELLS}")
    rows, _ = _read(spark, path, sep, encoding, glob, max_bytes)
    return rows.withColumn("cells", F.col("cells").cast(CELLS))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """The same rows as ``(source_file, row_idx, <cells>)``; a column a file does not have is null.

    The names of all columns, by first file and place, are collected for the schema.
    """
    rows, tables = _read(spark, path, sep, encoding, None, None)
    each = tables.select("source_file", F.posexplode("names").alias("at", "name"))
    names = [r["name"] for r in each.groupBy("name").agg(F.min(F.struct("source_file", "at")).alias("first")).orderBy("first").collect()]
    by_name = rows.select("source_file", "row_idx", F.map_from_entries("cells").alias("_cells"))
    return by_name.select("source_file", "row_idx", *[F.try_element_at("_cells", F.lit(n)).alias(n) for n in names])
