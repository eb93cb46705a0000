"""From documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.jaccard_join import jaccard_classes
from textmill.llm.language_id import UNKNOWN, identify, train
from textmill.llm.line_dedup import ALL_LINES, dedup_lines
from textmill.llm.mixing import mixed_documents
from textmill.llm.sentencepiece_codec import encode
from textmill.llm.shared import release, shared_folder

#: Share of a document's words that must be in the language it is given; texts that change
#: between languages stay, unless hardly any of them is in one.
LEAST_SHARE = 0.3
#: Mean log of how often words of the same bucket occur in labelled texts of the language against
#: an even spread, see ``identify``: held-out clean texts came out above -0.22, strings of random
#: letters at -1.2 in the median and below -0.7 but for the shortest.
LEAST_COMMON = -0.5


def _apart(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without columns of these names: such are renamed, and the way back."""
    own = {c: f"_{c}_of_input" for c in names if c in docs.columns}
    return docs.withColumnsRenamed(own), {new: old for old, new in own.items()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which a known language has a fair share, in words that are not foreign to the labelled texts.

    The model learns from the documents' own labels. Documents without text or letters go. Where no document has a label, there is nothing
    to judge by, and all documents with text stay.
    """
    model = train(docs, "doc_id", "text", "lang")
    if not model.labels:
        return docs.where(F.col("text").isNotNull())
    own, back = _apart(docs, "lang_pred", "score", "common")
    tagged = identify(own, model, "text", common_col="common")
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE) & (F.col("common") >= LEAST_COMMON)
    return tagged.where(known).drop("lang_pred", "score", "common").withColumnsRenamed(back).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines, of whatever length, within two edits of an earlier one; documents of which nothing is left go.

    By this definition single letters, braces, years and numbered headings stay only where they
    come first.
    """
    own, back = _apart(docs, "n_lines", "n_removed")
    done = dedup_lines(own, "doc_id", "text", min_chars=ALL_LINES)
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    kept = done.where(left).drop("n_lines", "n_removed").withColumnsRenamed(back)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by five-word shingles at a similarity of 0.8.

    Of rows that repeat an id one stays; rows with a null id stay.
    """
    classes = jaccard_classes(docs, "doc_id", "text", k=5, num=80, den=100)
    keep = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id")).distinct()
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    with_id = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col("_kept_id"), "left_semi")
    one = with_id.withColumn("_kept_turn", F.row_number().over(order)).where("_kept_turn = 1").select(*docs.columns)
    return one.union(docs.where("doc_id is null"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, 5 : 2 : 1 in turn."""
    return mixed_documents(docs, "doc_id", "text", "source")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"), "text", "ids", round_trip_col="round_trip")
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mixture),
    ("sentencepiece", token_ids),
]

#: SQL cannot express the trained model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)
        docs = spark.read.parquet(path)
    return docs
