"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill import errors
from textmill.functions.charset import decode_text
from textmill.functions.sentences import sentence_pieces
from textmill.functions.text import normalize
from textmill.functions.tokens import DEFAULT_COUNTER, word_count
from textmill.functions.vectors import l2_normalize
from textmill.operators import documents as docs_ops
from textmill.operators import results, row_chunks, table_clean
from textmill.operators.chunk_exact import chunk_exact, sentence_ends, snap_targets
from textmill.operators.chunk_pack import pack_text
from textmill.operators.documents import chunk_documents
from textmill.operators.embed import HashEmbedder, embed, embedding_inputs, model_inputs, prefixed
from textmill.operators.layout import Columns, layout_of
from textmill.operators.models import model_listing, with_model
from textmill.operators.ordering import dense_index
from textmill.operators.row_text import row_map, row_text
from textmill.options import JobOptions, Limits, option_error
from textmill.session import materialize, ship_package, spread, work_dir
from textmill.sources import archives, delimited
from textmill.sources.files import extension, file_error, route
from textmill.sources.sinks import write_results
from textmill.sources.tables import read_tables
from textmill.streaming import ingest
from textmill.streaming.ingest import stream_table

ship_package()

NBSP, ZERO_WIDTH = " ", "​"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy(text: Column, row: Column) -> Column:
    """Deterministic whitespace noise, so that every normalizer rule has work to do."""
    kind = row % 5
    return (
        F.when(kind == 0, F.replace(text, F.lit(" "), F.lit(NBSP)))
        .when(kind == 1, F.replace(text, F.lit(" "), F.lit("  ")))
        .when(kind == 2, F.concat(text, F.lit(ZERO_WIDTH)))
        .when(kind == 3, F.replace(text, F.lit("\n"), F.lit(" \r\n\t")))
        .otherwise(text)
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: one file per row, named by its id."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").cast("string").alias("source_file"), "text", "source", "lang")


def spread_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(documents(spark, sf_dir).select("doc_id", "source_file", "text", *columns), "doc_id")


# --- text ---------------------------------------------------------------------


def normalize_text(spark, sf_dir):
    d = spread_documents(spark, sf_dir)
    raw = noisy(F.col("text"), F.col("doc_id"))
    return d.select("doc_id", normalize(raw).alias("plain"), normalize(raw, "lowercase").alias("lowered"))


def normalize_upper(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("\ufeff "), F.replace("text", F.lit(" "), F.lit("\t ")), F.lit(" \n"))
    return c.select("conv_id", "turn", normalize(raw, "uppercase").alias("raised"))


def token_counts(spark, sf_dir):
    d = spread_documents(spark, sf_dir)
    return d.select("doc_id", DEFAULT_COUNTER.count("text").alias("token_count"))


def sentences(spark, sf_dir):
    d = spread_documents(spark, sf_dir)
    return d.select("doc_id", F.posexplode(sentence_pieces(normalize("text"))).alias("ord", "piece"))


def sentence_offsets(spark, sf_dir):
    d = spread_documents(spark, sf_dir)
    return sentence_ends(d.select("doc_id", normalize("text").alias("text")), "doc_id")


def snap_asof(spark, sf_dir):
    d = spread_documents(spark, sf_dir).select("doc_id", normalize("text").alias("text"))
    bounds = sentence_ends(d, "doc_id")
    width = 400
    targets = d.select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(width))).alias("start")
    ).withColumn("target", F.col("start") + width)
    return snap_targets(bounds, targets, "doc_id")


# --- chunking -----------------------------------------------------------------


def _packed(spark, sf_dir, max_tokens, overlap):
    d = spread_documents(spark, sf_dir)
    packed = pack_text(normalize("text"), max_tokens, overlap)
    return d.select("doc_id", F.posexplode(packed).alias("chunk_index", "c"))


def chunk_pack(spark, sf_dir):
    return _packed(spark, sf_dir, 512, 100).select("doc_id", "chunk_index", "c.text", "c.token_count")


def chunk_overlap(spark, sf_dir):
    return _packed(spark, sf_dir, 128, 32).select("doc_id", "chunk_index", "c.text", "c.token_count", "c.fresh_tokens")


def hard_cut(spark, sf_dir):
    return _packed(spark, sf_dir, 16, 0).select("doc_id", "chunk_index", "c.text", "c.token_count")


def chunk_exact_query(spark, sf_dir):
    d = spread_documents(spark, sf_dir).select("source_file", "doc_id", normalize("text").alias("text"))
    return chunk_exact(d, 512, 100, DEFAULT_COUNTER, "doc_id").drop("source_file")


def fits_in_one(spark, sf_dir):
    d = spread_documents(spark, sf_dir).withColumn("fits", word_count(normalize("text")) <= 512)
    return d.groupBy("fits").agg(F.count("*").alias("n_docs"))


# --- tables -------------------------------------------------------------------


def _text(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def customer_rows(spark, sf_dir) -> DataFrame:
    """All customers as one table, with blank and missing cells put in."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(
        F.lit("customer.csv").alias("source_file"),
        k.alias("row_idx"),
        *_text("c_custkey"),
        F.when(k % 11 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("c_name"),
        *_text("c_nationkey"),
        F.when(k % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return spread(rows, "row_idx")


def document_rows(spark, sf_dir) -> DataFrame:
    """Documents as wide table rows, one table per source."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.concat("source", F.lit(".csv")).alias("source_file"),
        F.col("doc_id").alias("row_idx"),
        *_text("doc_id"),
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"),
        "text",
    )
    return spread(rows, "row_idx")


def order_rows(spark, sf_dir) -> DataFrame:
    """Orders as one small table per customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("cust-"), F.col("o_custkey"), F.lit(".xlsx")).alias("source_file"),
        F.col("o_orderkey").alias("row_idx"),
        *_text("o_orderkey"),
        "o_orderstatus",
        "o_orderpriority",
    )


def row_text_query(spark, sf_dir):
    r = customer_rows(spark, sf_dir)
    return r.select("row_idx", row_text(layout_of(r)).alias("row_text"))


def row_text_bare(spark, sf_dir):
    r = customer_rows(spark, sf_dir)
    return r.select("row_idx", row_text(layout_of(r), include_column_names=False, normalization="lowercase").alias("row_text"))


def row_text_values_only(spark, sf_dir):
    r = customer_rows(spark, sf_dir)
    return r.select("row_idx", row_text(layout_of(r), values_only_threshold=3).alias("row_text"))


def row_text_column(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = row_text(Columns(["p_name", "p_brand", "p_type"]), normalization="uppercase", output_text_column="p_name")
    return p.select("p_partkey", text.alias("row_text"))


def gappy_orders(spark, sf_dir) -> DataFrame:
    """Orders per status with a column that is empty everywhere and one that is empty for some."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("source_file"),
        F.col("o_orderkey").alias("row_idx"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey").cast("string")).alias("custkey"),
        F.when((F.col("o_orderstatus") != "P") & (F.col("o_orderkey") % 3 != 0), F.col("o_orderpriority")).alias("priority"),
        F.lit(None).cast("string").alias("note"),
    )


def drop_null_columns(spark, sf_dir):
    return table_clean.drop_null_columns(gappy_orders(spark, sf_dir))


def drop_blank_rows(spark, sf_dir):
    return table_clean.drop_blank_rows(gappy_orders(spark, sf_dir)).drop("note")


def reindexed_rows(spark, sf_dir):
    kept = table_clean.drop_blank_rows(gappy_orders(spark, sf_dir))
    return dense_index(kept, "source_file", "row_idx", "dense_idx").select("source_file", "row_idx", "dense_idx")


def table_profile(spark, sf_dir):
    rows = gappy_orders(spark, sf_dir)
    return table_clean.source_profile(table_clean.table_profile(rows, layout_of(rows))).drop("header")


def event_sheets(spark, sf_dir) -> DataFrame:
    """Events as one sheet per type, with stretches of nearly empty rows of several lengths."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    sparse = (k % 1500 < 130 + 40 * F.length("event_type")) & (k > 600)
    return e.select(
        F.col("event_type").alias("source_file"),
        k.alias("row_idx"),
        *_text("event_id"),
        F.when(~sparse, F.col("user_id").cast("string")).alias("user_id"),
        F.when(~sparse, F.col("props")).otherwise(F.lit(" ")).alias("props"),
    )


def sparse_run_cut(spark, sf_dir):
    return table_clean.cut_sparse_rows(event_sheets(spark, sf_dir)).select("source_file", "row_idx", "user_id")


def table_gate(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    source = table_clean.source_profile(table_clean.table_profile(rows, layout_of(rows)))
    return table_clean.table_gate(source, 2, 8).select("source_file", "n_rows", "is_table")


CAP = Limits(max_table_rows=12)


def row_cap(spark, sf_dir):
    return table_clean.row_cap(order_rows(spark, sf_dir), CAP)[0]


def row_cap_errors(spark, sf_dir):
    return table_clean.row_cap(order_rows(spark, sf_dir), CAP)[1]


def part_rows(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_type").alias("source_file"), F.col("p_partkey").alias("row_idx"), "p_name", "p_brand", *_text("p_size"))


def char_token_ratio(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    return row_chunks.char_token_ratio(rows, JobOptions())


def char_token_ratio_column(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    return row_chunks.char_token_ratio(rows, JobOptions(output_text_column="p_name"))


ROW_COLUMNS = ["source_file", "row_idx", "chunk_index", "text", "token_count", "single_row", "row_split", "is_tabular", "table_type"]


def row_chunks_query(spark, sf_dir):
    return row_chunks.chunk_rows(customer_rows(spark, sf_dir), JobOptions(max_tokens=8, overlap=0)).select(*ROW_COLUMNS)


def row_split(spark, sf_dir):
    return row_chunks.chunk_rows(document_rows(spark, sf_dir), JobOptions(max_tokens=128, overlap=0)).select(*ROW_COLUMNS)


def row_split_bare(spark, sf_dir):
    options = JobOptions(max_tokens=64, overlap=0, attach_context_on_split=False, include_column_names=False, normalization="lowercase")
    return row_chunks.chunk_rows(document_rows(spark, sf_dir), options, ".xls").select(*ROW_COLUMNS)


def context_prefix(spark, sf_dir):
    rows = document_rows(spark, sf_dir)
    row = layout_of(rows).cells()
    per_chunk = F.lit(400) + F.col("row_idx") % 300
    return rows.select("row_idx", row_chunks.context_prefix(row, per_chunk, True).alias("prefix"))


def row_metadata(spark, sf_dir):
    chunks = row_chunks.chunk_rows(customer_rows(spark, sf_dir), JobOptions())
    return chunks.select(
        "chunk_index",
        F.col("row_data")["c_name"].alias("data_name"),
        F.col("row_data")["c_mktsegment"].alias("data_segment"),
        F.col("extra_metadata")["c_nationkey"].alias("root_nation"),
        F.size("row_data").alias("n_cells"),
        "table_columns",
    )


def unstructured_fallback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id")).alias("source_file"), F.col("turn").alias("row_idx"), F.col("text").alias("message")
    )
    chunks, _ = row_chunks.chunk_tables(turns, JobOptions(max_tokens=96, overlap=24))
    return chunks.select("source_file", "chunk_index", "text", "token_count", "is_tabular", "sentence_aware")


def chunk_tables(spark, sf_dir):
    chunks, _ = row_chunks.chunk_tables(order_rows(spark, sf_dir), JobOptions(min_rows_for_table=8), ".xlsx")
    return chunks.select("source_file", "chunk_index", "text", "token_count", "is_tabular", "sentence_aware", "table_type")


def turn_rows(spark, sf_dir) -> DataFrame:
    """Conversations as one small table each, a turn per row."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select(
        F.concat(F.lit("conv-"), F.col("conv_id"), F.lit(".csv")).alias("source_file"),
        F.col("turn").alias("row_idx"),
        *_text("turn"),
        "role",
        "text",
    )
    return spread(rows, "source_file", "row_idx")


def chunk_tables_turns(spark, sf_dir):
    options = JobOptions(max_tokens=48, overlap=8, min_rows_for_table=6)
    chunks, _ = row_chunks.chunk_tables(turn_rows(spark, sf_dir), options)
    return chunks.select("source_file", "chunk_index", "text", "token_count", "is_tabular", "row_split")


def line_files(spark, sf_dir) -> DataFrame:
    """Every document as a delimited file of its own: a header, then its lines with their numbers."""
    d = spread_documents(spark, sf_dir)
    sep = F.array(*[F.lit(x) for x in delimited.DELIMITERS])[(F.col("doc_id") % 4).cast("int")]
    record = lambda x, i: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'), sep, i.cast("string"))
    header = F.concat(F.lit("line"), sep, F.lit("no"))
    body = F.array_join(F.concat(F.array(header), F.transform(F.split("text", "\n"), record)), "\r\n")
    return d.select(F.concat("source_file", F.lit(".csv")).alias("source_file"), F.encode(body, "UTF-8").alias("content"))


def table_files(spark, sf_dir):
    rows = read_tables(line_files(spark, sf_dir))
    return rows.select("source_file", "row_idx", F.col("cells.name").alias("names"), F.col("cells.val").alias("vals"))


def chunk_table_files(spark, sf_dir):
    options = JobOptions(max_tokens=24, overlap=4, min_rows_for_table=5, values_only_threshold=1)
    # The table passes read the rows several times; parsed once, they read columns.
    chunks, _ = row_chunks.chunk_tables(materialize(read_tables(line_files(spark, sf_dir))), options)
    return chunks.select("source_file", "chunk_index", "text", "token_count", "is_tabular", "row_split", F.size("table_columns").alias("n_columns"))


def row_map_query(spark, sf_dir):
    r = customer_rows(spark, sf_dir)
    m = row_map(layout_of(r))
    return r.select("row_idx", F.map_keys(m).alias("names"), F.map_values(m).alias("vals"))


# --- models and vectors -------------------------------------------------------

# Names as in the model registry, and one that is not in it.
MODEL_NAMES = [
    "all-MiniLM-L6-v2", "paraphrase-multilingual-MiniLM-L12-v2", "bge-base-en-v1.5", "multilingual-e5-large", "e5-base-v2", "my/own-model",
]


def model_requests(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    names = F.array(*[F.lit(m) for m in MODEL_NAMES])
    return d.select(
        "doc_id",
        "text",
        names[(F.col("doc_id") % len(MODEL_NAMES)).cast("int")].alias("model_name"),
        F.when(F.col("doc_id") % 2 == 0, "query").otherwise("passage").alias("prefix_mode"),
    )


def model_lookup(spark, sf_dir):
    found = with_model(model_requests(spark, sf_dir).drop("text"))
    return found.select("doc_id", "model_name", "model_id", "max_length", "dimension", "language", "query_prefix", "passage_prefix")


def model_usage(spark, sf_dir):
    used = model_requests(spark, sf_dir).groupBy("model_name").agg(F.count("*").alias("n_docs"))
    listing = model_listing(spark).withColumnRenamed("name", "model_name").drop("description")
    return used.join(F.broadcast(listing), "model_name", "left")


def prefix_text(spark, sf_dir):
    r = with_model(model_requests(spark, sf_dir))
    text = prefixed("text", F.col("prefix_mode"), F.col("query_prefix"), F.col("passage_prefix"))
    return r.select("doc_id", text.alias("input_text"))


def truncate_text(spark, sf_dir):
    return model_inputs(spread(model_requests(spark, sf_dir), "doc_id")).select("doc_id", "input_text", "truncated")


def truncation_totals(spark, sf_dir):
    inputs = model_inputs(spread(model_requests(spark, sf_dir), "doc_id"))
    return inputs.groupBy("model_name").agg(F.count_if("truncated").alias("n_truncated"), F.count("*").alias("n_texts"))


def l2_normalize_query(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: x * (F.col("vec_id") % 5).cast("float"))
    return e.select("vec_id", l2_normalize(scaled).alias("unit"))


EMBED = JobOptions(model_name="e5-base-v2", max_tokens=256, overlap=32)


def embedded_chunks(spark, sf_dir) -> DataFrame:
    chunks = chunk_documents(spread_documents(spark, sf_dir), EMBED, "doc_id")
    return embed(chunks, HashEmbedder(), EMBED)


def hash_embed(spark, sf_dir):
    return embedded_chunks(spark, sf_dir).select("doc_id", "chunk_index", "embedding_model_id", "embedding")


def chunk_for_model(spark, sf_dir):
    options = JobOptions(model_name="multilingual-e5-large")
    chunks = chunk_documents(spread_documents(spark, sf_dir), options, "doc_id")
    return embedding_inputs(chunks, options).select("doc_id", "chunk_index", "token_count", "input_text", "truncated")


# --- results ------------------------------------------------------------------


def named_documents(spark, sf_dir) -> DataFrame:
    """Documents as files of several kinds; the source is the archive they came in."""
    d = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.lit(x) for x in (".txt", ".TXT", ".docx", ".pdf", ".png", "")])
    name = F.concat(F.lit("doc-"), F.col("doc_id"), kinds[(F.col("doc_id") % 6).cast("int")])
    return d.select("doc_id", name.alias("source_file"), "text", F.col("source").alias("container_file"), F.col("n_chars").alias("length"))


SMALL_FILES = Limits(max_file_bytes=9000)


def checked_documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return errors.split_errors(
        named_documents(spark, sf_dir), file_error(F.col("source_file"), F.col("length"), SMALL_FILES)
    )


def _result_chunks(good: DataFrame) -> DataFrame:
    return chunk_documents(spread(good, "doc_id"), JobOptions(max_tokens=128, overlap=16), "container_file")


def quarantine(spark, sf_dir):
    return checked_documents(spark, sf_dir)[1]


def route_files(spark, sf_dir):
    d = named_documents(spark, sf_dir)
    ext = extension(F.col("source_file"))
    return d.select("doc_id", ext.alias("file_ext"), route(ext).alias("branch"))


def result_files(spark, sf_dir) -> DataFrame:
    """All documents, every eleventh blank, as members of their sources."""
    d = named_documents(spark, sf_dir)
    return d.withColumn("text", F.when(F.col("doc_id") % 11 != 5, F.col("text")).otherwise(F.lit(" \n")))


def _names(files: DataFrame) -> DataFrame:
    return files.select(F.col("container_file").alias("filename"), F.col("source_file").alias("member"))


def file_results(spark, sf_dir):
    files = result_files(spark, sf_dir)
    nested = results.file_results(_result_chunks(files), "container_file", files=_names(files))
    return nested.select(
        "filename",
        "member",
        "part",
        F.size("chunks").alias("n_chunks"),
        F.col("chunks.text").alias("texts"),
        F.col("chunks.metadata.token_count").alias("token_counts"),
        F.col("chunks.metadata.source_file").alias("source_files"),
        F.col("chunks.metadata.chunk_index").alias("chunk_indexes"),
        F.col("chunks.metadata.sentence_aware").alias("sentence_aware"),
        F.col("chunks.metadata.is_tabular").alias("is_tabular"),
    )


def results_with_errors(spark, sf_dir):
    good, bad = checked_documents(spark, sf_dir)
    nested = results.with_errors(results.file_results(_result_chunks(good)), bad)
    return nested.select(
        "filename", F.coalesce(F.size("chunks"), F.lit(0)).alias("n_chunks"), F.col("error.error_code").alias("error_code")
    )


def totals(spark, sf_dir):
    good, bad = checked_documents(spark, sf_dir)
    return results.totals(_result_chunks(good), bad)


def container_totals(spark, sf_dir):
    files = result_files(spark, sf_dir)
    return results.totals(_result_chunks(files), file="container_file", files=_names(files))


def member_totals(spark, sf_dir):
    files = result_files(spark, sf_dir)
    return results.totals(_result_chunks(files), files=_names(files).select(F.col("member").alias("filename")))


def grand_total(spark, sf_dir):
    return results.grand_total(_result_chunks(result_files(spark, sf_dir)))


def word_vectors(spark, sf_dir) -> DataFrame:
    """Chunks with the embedder's vectors before they are normalized: whole numbers, so that files can be compared to the byte."""
    chunks = chunk_documents(spread_documents(spark, sf_dir), EMBED, "doc_id")
    return embedding_inputs(chunks, EMBED).withColumn("embedding", HashEmbedder().expression("input_text")).drop("input_text")


def npy_export(spark, sf_dir):
    return results.npy_matrices(word_vectors(spark, sf_dir)).select("filename", "part", "n_chunks", F.hex("npy").alias("npy"))


def base64_export(spark, sf_dir):
    return results.base64_matrices(word_vectors(spark, sf_dir)).select("filename", "part", "n_chunks", "embeddings_base64_npy")


def written_results(spark, sf_dir):
    """Results of all documents written as JSON with matrices and read back."""
    path = f"{work_dir(spark)}/results"
    _, bad = checked_documents(spark, sf_dir)
    write_results(word_vectors(spark, sf_dir), bad, path, "json_with_embeddings")
    back = spark.read.json(path)
    return back.select(
        "filename",
        F.coalesce(F.size("chunks"), F.lit(0)).alias("n_chunks"),
        F.col("chunks.text").alias("texts"),
        "embeddings_base64_npy",
        F.col("error.error_code").alias("error_code"),
    )


# --- sources ------------------------------------------------------------------


def decode_text_query(spark, sf_dir):
    d = spread_documents(spark, sf_dir)
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return d.select("doc_id", decode_text(raw).alias("text"))


def delimiter_profile(spark, sf_dir):
    """Orders as lines of one file per priority, each file with its own delimiter."""
    o = table(spark, sf_dir, "orders")
    line = F.lit(None).cast("string")
    for digit, sep in enumerate((",", ";", "\t", "|", ","), 1):
        cells = F.concat_ws(sep, "o_orderkey", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('; x, y"')), "o_orderstatus")
        line = F.when(F.col("o_orderpriority").startswith(str(digit)), cells).otherwise(line)
    lines = o.select(F.col("o_orderpriority").alias("source_file"), line.alias("line"))
    return delimited.delimiter_profile(lines)


def archive_manifest(spark, sf_dir) -> DataFrame:
    """Documents as members of one archive per source, some encrypted, some folders."""
    d = named_documents(spark, sf_dir)
    k = F.col("doc_id")
    source_no = F.substring("container_file", 4, 9).cast("int")
    return d.select(
        F.concat("container_file", F.lit(".zip")).alias("archive"),
        F.when(k % 13 == 0, F.concat(F.lit("folder-"), k, F.lit("/"))).when(k % 17 == 0, F.concat(F.lit("in-"), k, F.lit(".zip"))).otherwise(
            F.col("source_file")
        ).alias("member"),
        k.cast("int").alias("ordinal"),
        (F.col("length") * F.when(source_no % 5 == 0, 1000).otherwise(1)).alias("file_size"),
        F.when((source_no % 7 == 3) & (k % 3 == 0), 1).otherwise(0).alias("flag_bits"),
        (k % 13 == 0).alias("is_dir"),
    )


ARCHIVE_LIMIT = Limits(max_archive_bytes=5_000_000)


def archive_policy(spark, sf_dir):
    return archives.archive_policy(archive_manifest(spark, sf_dir), limits=ARCHIVE_LIMIT)[0]


def archive_errors(spark, sf_dir):
    return archives.archive_policy(archive_manifest(spark, sf_dir), limits=ARCHIVE_LIMIT)[1]


def archive_members(spark, sf_dir):
    """Documents packed into archives and read out of them again: members by name, each a document of its own."""
    d = spread_documents(spark, sf_dir)

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, text in zip(rows["member"], rows["text"], strict=True):
                archive.writestr(name, text)
        return pd.DataFrame({"source_file": rows["archive"].iloc[:1], "content": [buffer.getvalue()]})

    named = d.select(
        F.concat(F.lit("pack-"), F.floor(F.col("doc_id") / 64), F.lit(".zip")).alias("archive"),
        F.concat(F.lit("in/doc-"), "doc_id", F.when(F.col("doc_id") % 9 == 4, ".log").otherwise(".txt")).alias("member"),
        "text",
    )
    files = materialize(named.groupBy("archive").applyInPandas(packed, "source_file string, content binary"))
    manifest, _ = archives.read_manifest(files)
    wanted, _ = archives.archive_policy(materialize(manifest))
    members, _ = archives.read_members(files, wanted)
    return members.select("container_file", F.col("source_file").alias("member"), decode_text("content").alias("text"))


def empty_tables(spark, sf_dir):
    """Delimited files of the nations of a region; every other file has a header alone and gives no chunk."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r"), F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    grouped = n.groupBy("r").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    text = F.concat(F.lit("key,name\n"), F.when(F.col("r") % 2 == 0, F.col("lines")).otherwise(""))
    files = grouped.select(F.concat(F.lit("region-"), "r", F.lit(".csv")).alias("source_file"), F.encode(text, "UTF-8").alias("content"))
    chunks, _ = row_chunks.chunk_tables(materialize(read_tables(files)), JobOptions())
    return chunks.groupBy("source_file").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_list("text")).alias("texts"))


def empty_embedding(spark, sf_dir):
    """Documents without a character, of which the tables have none: no chunk, no vector, the same columns."""
    d = documents(spark, sf_dir).where(F.length(F.trim("text")) == 0)
    return embed(chunk_documents(d, EMBED, "doc_id"), HashEmbedder(), EMBED).select("doc_id", "chunk_index", "embedding_model_id", "embedding")


def rejected_options(spark, sf_dir):
    """Options of a job per part, some out of their range, checked as a column."""
    p = table(spark, sf_dir, "part")
    asked = p.select(
        F.concat(F.lit("part-"), "p_partkey").alias("source_file"),
        (F.col("p_size") - 3).alias("max_tokens"),
        (F.col("p_partkey") % 40).cast("int").alias("overlap"),
        (F.col("p_partkey") % 13 - 1).cast("int").alias("values_only_threshold"),
        F.when(F.col("p_partkey") % 7 == 0, "titlecase").otherwise("lowercase").alias("normalization"),
    )
    return errors.split_errors(asked, option_error(asked.columns))[1]


def page_concat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("page_no"), F.when(F.col("turn") % 4 != 3, F.col("text")).otherwise("").alias("text")
    )
    return docs_ops.page_concat(turns)[0]


def block_dedupe(spark, sf_dir):
    """Lines of the documents as blocks: every third a paragraph, the others table cells."""
    d = spread_documents(spark, sf_dir)
    lines = d.select(F.col("source_file").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    kind = F.when(F.col("ord") % 3 == 0, "paragraph").otherwise("cell")
    padded = F.when(F.col("ord") % 4 == 1, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return docs_ops.block_dedupe(lines.select("doc", kind.alias("kind"), "ord", padded.alias("text")))[0]


def delimited_round_trip(spark, sf_dir):
    """Parts written as delimited text and read back with a detected delimiter."""
    path = f"{work_dir(spark)}/part.csv"
    p = table(spark, sf_dir, "part")
    cells = p.select(
        "p_partkey",
        F.concat("p_name", F.lit("; "), F.col("p_brand")).alias("p_label"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_type")).otherwise("N/A").alias("p_type"),
        F.lpad(F.col("p_size").cast("string"), 3, "0").alias("p_size"),
    )
    cells.write.options(header="true", sep=";").csv(path)
    rows = delimited.read_delimited(spark, path)
    return rows.select("p_partkey", "p_label", "p_type", "p_size")


def spanning_cells(spark, sf_dir):
    """Documents written as delimited text, line breaks in their cells, and read back in splits."""
    path = f"{work_dir(spark)}/documents.csv"
    d = documents(spark, sf_dir).select("doc_id", "text", F.concat("lang", F.lit(', "'), "source", F.lit('"')).alias("origin"))
    d.write.options(header="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return delimited.read_delimited(spark, path).select("doc_id", "text", "origin")


def incremental_ingest(spark, sf_dir):
    """The documents as a stream of files, chunked by the batch plan."""
    out = work_dir(spark)
    docs = stream_table(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source_file"), "text", "doc_id")
    ingest.ingest(docs, f"{out}/chunks", f"{out}/checkpoint", JobOptions(), keep=("doc_id",)).awaitTermination()
    return spark.read.parquet(f"{out}/chunks").select("doc_id", "chunk_index", "text", "token_count")


QUERIES = {
    "normalize_text": normalize_text,
    "normalize_upper": normalize_upper,
    "token_counts": token_counts,
    "sentences": sentences,
    "sentence_offsets": sentence_offsets,
    "snap_asof": snap_asof,
    "chunk_pack": chunk_pack,
    "chunk_overlap": chunk_overlap,
    "hard_cut": hard_cut,
    "chunk_exact": chunk_exact_query,
    "single_chunk_docs": fits_in_one,
    "row_text": row_text_query,
    "row_text_bare": row_text_bare,
    "row_text_values_only": row_text_values_only,
    "row_text_column": row_text_column,
    "row_map": row_map_query,
    "drop_null_columns": drop_null_columns,
    "drop_blank_rows": drop_blank_rows,
    "reindexed_rows": reindexed_rows,
    "table_profile": table_profile,
    "sparse_run_cut": sparse_run_cut,
    "table_gate": table_gate,
    "row_cap": row_cap,
    "row_cap_errors": row_cap_errors,
    "char_token_ratio": char_token_ratio,
    "char_token_ratio_column": char_token_ratio_column,
    "row_chunks": row_chunks_query,
    "row_split": row_split,
    "row_split_bare": row_split_bare,
    "context_prefix": context_prefix,
    "row_metadata": row_metadata,
    "unstructured_fallback": unstructured_fallback,
    "chunk_tables": chunk_tables,
    "chunk_tables_turns": chunk_tables_turns,
    "table_files": table_files,
    "chunk_table_files": chunk_table_files,
    "model_lookup": model_lookup,
    "model_usage": model_usage,
    "prefix_text": prefix_text,
    "truncate_text": truncate_text,
    "truncation_totals": truncation_totals,
    "l2_normalize": l2_normalize_query,
    "hash_embed": hash_embed,
    "chunk_for_model": chunk_for_model,
    "quarantine": quarantine,
    "route_files": route_files,
    "file_results": file_results,
    "results_with_errors": results_with_errors,
    "totals": totals,
    "container_totals": container_totals,
    "member_totals": member_totals,
    "grand_total": grand_total,
    "written_results": written_results,
    "npy_export": npy_export,
    "base64_export": base64_export,
    "decode_text": decode_text_query,
    "delimiter_profile": delimiter_profile,
    "spanning_cells": spanning_cells,
    "archive_members": archive_members,
    "empty_tables": empty_tables,
    "empty_embedding": empty_embedding,
    "rejected_options": rejected_options,
    "archive_policy": archive_policy,
    "archive_errors": archive_errors,
    "page_concat": page_concat,
    "block_dedupe": block_dedupe,
    "delimited_round_trip": delimited_round_trip,
    "incremental_ingest": incremental_ingest,
}
