import base64
import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions.vectors import l2_normalize
from textmill.operators.documents import chunk_documents
from textmill.operators.embed import HashEmbedder, OnnxEmbedder, embed, embedding_inputs, model_inputs
from textmill.operators.models import REGISTRY, model_config, model_listing, with_model
from textmill.operators.results import base64_matrices, file_results, grand_total, npy_matrices, totals, with_errors
from textmill.options import JobOptions
from textmill.schemas import ERRORS
from textmill.sources.sinks import write_chunks, write_results


def chunks_of(spark, options=JobOptions(max_tokens=4, overlap=1)):
    docs = spark.createDataFrame([("a.txt", "One two three. Four five six. Seven. Eight nine ten."), ("b.txt", "Hi.")], "source_file string, text string")
    return chunk_documents(docs, options)


def test_l2(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],)], "v array<double>")
    got = [r.u for r in df.select(l2_normalize("v").alias("u")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0] and got[2] == []


def test_models(spark):
    assert len(REGISTRY) == 9
    listing = model_listing(spark).collect()
    assert [r.name for r in listing if r.is_default] == ["all-MiniLM-L6-v2"] and listing[5].max_seq_length == 8192
    unknown = model_config("own/model")
    assert (unknown["max_length"], unknown["query_prefix"], unknown["dimension"]) == (512, "", None)
    found = with_model(spark.createDataFrame([("own/model",), ("e5-base-v2",)], "model_name string"))
    rows = {r.model_name: r for r in found.collect()}
    assert rows["own/model"].model_id == "own/model" and rows["own/model"].max_length == 512
    assert rows["e5-base-v2"].passage_prefix == "passage: "
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_prefix_and_truncation(spark):
    df = spark.createDataFrame([("t",)], "text string")
    for model, mode, want in [
        ("e5-base-v2", "passage", "passage: t"), ("e5-base-v2", "query", "query: t"), ("bge-base-en-v1.5", "passage", "t"),
        ("bge-base-en-v1.5", "query", "Represent this sentence for searching relevant passages: t"), ("x/y", "query", "t"),
    ]:
        assert embedding_inputs(df, JobOptions(model_name=model, prefix_mode=mode)).first().input_text == want
        asked = df.select("text", F.lit(model).alias("model_name"), F.lit(mode).alias("prefix_mode"))
        assert model_inputs(asked).first().input_text == want
    long = spark.createDataFrame([("w " * 300,)], "text string")
    cut = embedding_inputs(long, JobOptions(model_name="paraphrase-multilingual-MiniLM-L12-v2")).first()
    assert cut.truncated and len(cut.input_text.split()) == 128


def test_embed(spark):
    chunks = chunks_of(spark)
    options = JobOptions(model_name="e5-base-v2", embedding_batch_size=2)
    rows = embed(chunks, HashEmbedder(16), options).collect()
    assert len(rows) == chunks.count()
    for r in rows:
        assert r.embedding_model_id == "e5-base-v2" and len(r.embedding) == 16
        assert math.isclose(sum(x * x for x in r.embedding), 1.0, rel_tol=1e-5)
    skipped = embed(chunks, HashEmbedder(16), JobOptions(skip_embedding=True))
    assert "embedding" not in skipped.columns and {r.embedding_model_id for r in skipped.collect()} == {None}
    assert embed(chunks.limit(0), HashEmbedder(16), options).count() == 0


def field(number: int, kind: int, payload: bytes | int) -> bytes:
    """One protobuf field: a varint (kind 0) or bytes (kind 2)."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    head = varint(number << 3 | kind)
    return head + (varint(payload) if kind == 0 else varint(len(payload)) + payload)


def tiny_model(weights: np.ndarray) -> bytes:
    """A model file whose only node looks token ids up in ``weights``."""
    tensor = b"".join(field(1, 0, d) for d in weights.shape) + field(2, 0, 1) + field(8, 2, b"w") + field(9, 2, weights.astype("<f4").tobytes())
    node = field(1, 2, b"w") + field(1, 2, b"input_ids") + field(2, 2, b"hidden") + field(4, 2, b"Gather")

    def value(name: bytes, elem: int, rank: int) -> bytes:
        shape = b"".join(field(1, 2, field(2, 2, f"{name.decode()}{i}".encode())) for i in range(rank))
        return field(1, 2, name) + field(2, 2, field(1, 2, field(1, 0, elem) + field(2, 2, shape)))

    graph = (
        field(1, 2, node) + field(2, 2, b"g") + field(5, 2, tensor) + field(11, 2, value(b"input_ids", 7, 2)) + field(12, 2, value(b"hidden", 1, 3))
    )
    return field(1, 0, 8) + field(7, 2, graph) + field(8, 2, field(1, 2, b"") + field(2, 0, 13))


def test_onnx_embedder(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("onnxruntime")
    tok = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0, "one": 1, "two": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "m.onnx").write_bytes(tiny_model(np.array([[9, 9], [1, 0], [0, 1]], dtype=np.float32)))
    df = spark.createDataFrame([("one one one two",), ("two",)], "text string")
    got = embed(df, OnnxEmbedder(str(tmp_path / "m.onnx"), str(tmp_path / "tokenizer.json")), JobOptions()).collect()
    norm = math.hypot(3, 1)
    # Padding of the shorter text stays out of its mean.
    assert got[0].embedding == pytest.approx([3 / norm, 1 / norm]) and got[1].embedding == pytest.approx([0, 1])


def failed(spark):
    return spark.createDataFrame([("c.png", "UNSUPPORTED_FORMAT", "no", None)], ERRORS)


def test_results_come_in_parts(spark):
    chunks = embed(chunks_of(spark), HashEmbedder(8), JobOptions())
    n = chunks.where("source_file = 'a.txt'").count()
    nested = file_results(chunks, size=2).where("filename = 'a.txt'").orderBy("part").collect()
    assert len(nested) == math.ceil(n / 2) and all(len(r.chunks) <= 2 and len(r.embeddings) == len(r.chunks) for r in nested)
    assert [c.metadata.chunk_index for r in nested for c in r.chunks] == list(range(n))

    by_index = {r.chunk_index: r.embedding for r in chunks.where("source_file = 'a.txt'").collect()}
    parts = npy_matrices(chunks, size=2).where("filename = 'a.txt'").orderBy("part").collect()
    whole = np.concatenate([np.load(io.BytesIO(r.npy)) for r in parts])
    assert whole.dtype == np.float32 and whole.tolist() == [by_index[i] for i in range(n)]
    encoded = base64_matrices(chunks).where("filename = 'a.txt'").first().embeddings_base64_npy
    assert np.load(io.BytesIO(base64.b64decode(encoded, validate=True))).tolist() == whole.tolist()


def test_totals_and_errors(spark):
    chunks = chunks_of(spark)
    both = with_errors(file_results(chunks), failed(spark)).collect()
    assert {r.filename: (r.error.error_code if r.error else None) for r in both} == {"a.txt": None, "b.txt": None, "c.png": "UNSUPPORTED_FORMAT"}
    counts = {r.filename: r.total_chunks for r in totals(chunks, failed(spark)).collect()}
    assert counts["c.png"] == 0 and counts["b.txt"] == 1 and sum(counts.values()) == grand_total(chunks).first().total_chunks


@pytest.mark.parametrize("shape", ["json", "json_with_embeddings", "zip"])
def test_written_results(spark, tmp_path, shape):
    chunks = embed(chunks_of(spark), HashEmbedder(8), JobOptions())
    out = str(tmp_path / shape)
    write_results(chunks, failed(spark), out, shape)
    records = [json.loads(r.value) for r in spark.read.text(out if shape != "zip" else f"{out}/results").collect()]
    assert {r["filename"] for r in records} == {"a.txt", "b.txt", "c.png"}
    good = next(r for r in records if r["filename"] == "b.txt")
    assert good["chunks"][0]["text"] == "Hi." and good["chunks"][0]["metadata"]["sentence_aware"] is True
    assert ("embeddings" in good) == (shape == "json") and ("embeddings_base64_npy" in good) == (shape == "json_with_embeddings")
    if shape == "zip":
        names = {r.npy_name for r in spark.read.parquet(f"{out}/matrices").collect()}
        assert names == {"a.txt.00000.npy", "b.txt.00000.npy"}
    write_chunks(chunks.drop("embedding"), str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).count() == chunks.count()


def test_unknown_shape(spark, tmp_path):
    with pytest.raises(ValueError):
        write_results(chunks_of(spark), failed(spark), str(tmp_path), "xml")


def test_a_text_the_model_fails_on_is_an_error(spark):
    from textmill.operators.embed import embedding_errors

    class Fragile:
        def make_predict_fn(self, max_length):
            def make():
                import numpy as np

                def predict(texts):
                    return np.array([[np.nan] * 2 if "bad" in t else [3.0, 4.0] for t in texts.reshape(-1)])

                return predict

            return make

    chunks = spark.createDataFrame([("a", 0, "good"), ("b", 0, "bad")], "source_file string, chunk_index int, text string")
    got = embed(chunks, Fragile(), JobOptions())
    assert {r.source_file: r.embedding for r in got.collect()} == {"a": [pytest.approx(0.6), pytest.approx(0.8)], "b": None}
    assert [(r.source_file, r.error_code) for r in embedding_errors(got).collect()] == [("b", "PROCESSING_ERROR")]


def test_hash_vectors_need_no_python(spark):
    got = embed(chunks_of(spark), HashEmbedder(16), JobOptions())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "truncated" in got.columns


def test_vectors_and_chunks_are_made_once_for_an_export(spark, tmp_path, monkeypatch):
    from textmill.sources import sinks

    chunks = chunks_of(spark).withColumn("embedding", HashEmbedder(8).expression("text"))
    plan = npy_matrices(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    calls, real = [], sinks.materialize
    monkeypatch.setattr(sinks, "materialize", lambda df: calls.append(df) or real(df))
    write_results(chunks, failed(spark), str(tmp_path / "out"), "json_with_embeddings")
    assert len(calls) == 1
    none = chunks.withColumn("embedding", F.when(F.col("chunk_index") == 0, F.col("embedding")))
    parts = npy_matrices(none, size=1).select("filename", "part", "n_chunks").collect()
    assert parts and all(r.part == 0 and r.n_chunks == 1 for r in parts)


@pytest.mark.parametrize("dimension", [8, 94, 95, 300])
def test_hash_embedder_counts_words_by_slot(spark, dimension):
    import hashlib

    text = "one two one $1 \\ [x] two\u3000three !! ~ '"
    want = [0.0] * dimension
    for word in text.split():
        want[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension] += 1
    got = spark.createDataFrame([(text,), ("",)], "text string").select(HashEmbedder(dimension).expression("text").alias("v")).collect()
    assert got[0].v == want and got[1].v == [0.0] * dimension
