"""Prefix, truncation and embedding of chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill import errors
from textmill.functions.columns import as_column, let
from textmill.functions.tokens import words
from textmill.functions.vectors import l2_normalize
from textmill.operators.models import model_config, with_model
from textmill.options import JobOptions

PredictFn = Callable[[np.ndarray], np.ndarray]


def prefixed(text: Column | str, mode: Column, query_prefix: Column, passage_prefix: Column) -> Column:
    """Instruction prefix in front of a text (E3); any mode but ``query`` means passage."""
    return F.concat(F.when(mode == "query", query_prefix).otherwise(passage_prefix), as_column(text))


def model_inputs(df: DataFrame, model: str = "model_name", mode: str = "prefix_mode", counter=None) -> DataFrame:
    """What each model is given, for per-row model names and modes."""
    counter = counter or JobOptions().counter
    text = prefixed("text", F.col(mode), F.col("query_prefix"), F.col("passage_prefix"))
    sized = with_model(df, model).withColumn("input_text", text)
    return sized.withColumn("truncated", counter.count("input_text") > F.col("max_length")).withColumn(
        "input_text", counter.truncate("input_text", F.col("max_length"))
    )


def embedding_inputs(chunks: DataFrame, options: JobOptions) -> DataFrame:
    """``input_text`` and ``truncated`` for one model; its prefix and limit are plan constants."""
    config = model_config(options.model_name)
    prefix = config["query_prefix" if options.prefix_mode == "query" else "passage_prefix"]
    limit = config["max_length"]
    text = F.concat(F.lit(prefix), "text") if prefix else F.col("text")
    sized = chunks.withColumn("input_text", text)
    return sized.withColumn("truncated", options.counter.count("input_text") > limit).withColumn(
        "input_text", options.counter.truncate("input_text", limit)
    )


@dataclass(frozen=True)
class HashEmbedder:
    """Counts of hashed words: an offline stand-in that needs no model file.

    It is a Column expression, so no Python worker takes part.
    """

    dimension: int = 64

    def expression(self, text: Column | str, max_length: int | None = None) -> Column:
        # A letter per slot: a text becomes a string of them, whose letters are counted. Letters
        # of one byte, where there are enough, halve what is searched.
        first = 0x21 if self.dimension <= 0x7F - 0x21 else 0x100
        letters = [chr(first + k) for k in range(self.dimension)]
        by_slot = F.array(*[F.lit(c) for c in letters])

        def slot(word: Column) -> Column:
            number = F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint")
            return F.get(by_slot, (number % self.dimension).cast("int"))

        def counts(slots: Column) -> Column:
            size = F.length(slots)
            rest = lambda c: F.length(F.replace(slots, F.lit(c), F.lit("")))
            return F.array(*[(size - rest(c)).cast("float") for c in letters])

        return let(F.array_join(F.transform(words(as_column(text)), slot), ""), counts)


@dataclass(frozen=True)
class OnnxEmbedder:
    """Mean-pooled token vectors of a local ONNX model, loaded once per Python worker.

    Both files must be readable by every worker. The attention mask keeps padding
    out of the mean. ``max_length`` is the model's own limit, in its tokens and with
    its special tokens; ``embed`` takes it from the registry where it is not set.
    """

    model_path: str
    tokenizer_path: str
    max_length: int | None = None

    def make_predict_fn(self, max_length: int | None = None) -> Callable[[], PredictFn]:
        model_path, tokenizer_path, limit = self.model_path, self.tokenizer_path, self.max_length or max_length

        def make() -> PredictFn:
            import onnxruntime
            import tokenizers

            tok = tokenizers.Tokenizer.from_file(tokenizer_path)
            if limit:
                tok.enable_truncation(limit)
            tok.enable_padding()
            session = onnxruntime.InferenceSession(model_path, providers=onnxruntime.get_available_providers())
            wanted = [i.name for i in session.get_inputs()]

            def vectors(texts: np.ndarray) -> np.ndarray:
                encoded = tok.encode_batch([str(t) for t in texts.reshape(-1)])
                mask = np.array([e.attention_mask for e in encoded], dtype=np.int64)
                feeds = {
                    "input_ids": np.array([e.ids for e in encoded], dtype=np.int64),
                    "attention_mask": mask,
                    "token_type_ids": np.zeros_like(mask),
                }
                hidden = session.run(None, {k: v for k, v in feeds.items() if k in wanted})[0]
                weight = mask[..., None].astype(np.float32)
                return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1.0)

            def predict(texts: np.ndarray) -> np.ndarray:
                try:
                    return vectors(texts)
                except Exception:  # one text may not end the job: it gets no vector, the others theirs
                    rows = []
                    for text in texts.reshape(-1):
                        try:
                            rows.append(vectors(np.array([text], dtype=object))[0])
                        except Exception:
                            rows.append(None)
                    size = next((len(r) for r in rows if r is not None), 1)
                    return np.array([np.full(size, np.nan, np.float32) if r is None else r for r in rows])

            return predict

        return make


def embed(chunks: DataFrame, embedder, options: JobOptions = JobOptions()) -> DataFrame:
    """Chunks with ``embedding array<float>`` and ``truncated`` on the row.

    The vector stays with its chunk, so nothing has to be matched by position
    later. ``truncated`` says whether the model was given less than the chunk.
    A text the model fails on keeps its chunk without a vector, see
    :func:`embedding_errors`. ``skip_embedding`` leaves the whole stage out. An embedder gives an ``expression``
    or, for a model outside the JVM, a ``make_predict_fn``.
    """
    if options.skip_embedding:
        return chunks
    limit = model_config(options.model_name)["max_length"]
    if hasattr(embedder, "expression"):
        vector = embedder.expression("input_text", limit)
    else:
        vector = predict_batch_udf(
            embedder.make_predict_fn(limit),
            return_type=T.ArrayType(T.FloatType()),
            batch_size=options.embedding_batch_size,
        )("input_text")
    return (
        embedding_inputs(chunks, options)
        .withColumn("embedding", vector)
        .withColumn("embedding", F.when(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)), l2_normalize("embedding")))
        .withColumn("embedding_model_id", F.lit(options.model_name))
        .drop("input_text")
    )


def embedding_errors(embedded: DataFrame) -> DataFrame:
    """Error records of the files with a chunk the model failed on."""
    failed = embedded.where(F.col("embedding").isNull())
    return errors.processing_errors(failed, F.format_string("no vector for chunk %d", F.col("chunk_index")))
