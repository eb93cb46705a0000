"""Model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.schemas import MODELS

_RETRIEVAL = "Represent this sentence for searching relevant passages: "

# The known embedding models, in registry order.
# name, model_id, max_length, language, description, dimension, query_prefix, passage_prefix
REGISTRY = [
    ("all-MiniLM-L6-v2", "sentence-transformers/all-MiniLM-L6-v2", 256, "en",
     "Fast English model, good balance of speed and quality", 384, "", ""),
    ("paraphrase-multilingual-MiniLM-L12-v2", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", 128, "multi",
     "Multilingual model supporting 50+ languages including Turkish", 384, "", ""),
    ("all-mpnet-base-v2", "sentence-transformers/all-mpnet-base-v2", 384, "en",
     "High quality English model, best overall performance", 768, "", ""),
    ("bge-base-en-v1.5", "BAAI/bge-base-en-v1.5", 512, "en",
     "BGE base English model with strong retrieval performance", 768, _RETRIEVAL, ""),
    ("bge-large-en-v1.5", "BAAI/bge-large-en-v1.5", 512, "en",
     "BGE large English model, top-tier retrieval quality", 1024, _RETRIEVAL, ""),
    ("BAAI/bge-m3", "BAAI/bge-m3", 8192, "multi",
     "BGE M3 multilingual model, supports 100+ languages", 1024, "", ""),
    ("multilingual-e5-large", "intfloat/multilingual-e5-large", 512, "multi",
     "E5 large multilingual model, strong cross-lingual retrieval", 1024, "query: ", "passage: "),
    ("e5-base-v2", "intfloat/e5-base-v2", 512, "en",
     "E5 base v2 English model, efficient retrieval performance", 768, "query: ", "passage: "),
    ("e5-large-v2", "intfloat/e5-large-v2", 512, "en",
     "E5 large v2 English model, high quality retrieval", 1024, "query: ", "passage: "),
]

# What is assumed of a model that is not listed.
UNKNOWN = {
    "max_length": 512,
    "language": "unknown",
    "description": "User-provided model (not in built-in registry)",
    "dimension": None,
    "query_prefix": "",
    "passage_prefix": "",
}


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, MODELS)


def model_listing(spark: SparkSession) -> DataFrame:
    """What a user may choose from, with the default model marked."""
    return models(spark).select(
        "name",
        "dimension",
        F.col("max_length").alias("max_seq_length"),
        "language",
        "description",
        (F.col("name") == REGISTRY[0][0]).alias("is_default"),
    )


def model_config(name: str) -> dict:
    """Registry entry of one model, or the permissive defaults of an unknown one."""
    for entry in REGISTRY:
        if entry[0] == name:
            return dict(zip(MODELS.names, entry))
    return {"name": name, "model_id": name, **UNKNOWN}


def with_model(df: DataFrame, model: str = "model_name") -> DataFrame:
    """Model attributes for a column of model names.

    The registry is a constant of nine rows, so broadcasting it is always safe.
    """
    known = models(df.sparkSession).withColumnRenamed("name", model)
    joined = df.join(F.broadcast(known), model, "left")
    filled = {"model_id": F.coalesce("model_id", F.col(model))}
    for name, value in UNKNOWN.items():
        if value is not None:
            filled[name] = F.coalesce(F.col(name), F.lit(value))
    return joined.withColumns(filled)
