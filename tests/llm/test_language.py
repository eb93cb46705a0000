import itertools
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from textmill.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, source string"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    score, moves, start = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([5, 3, 1])
    marginal, pairs, log_z = li.forward_backward(score, lengths, moves, start)
    total_pairs = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        z, by, pair = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = start[path[0]] + sum(score[c, t, y] for t, y in enumerate(path))
            s += sum(moves[a, b] for a, b in itertools.pairwise(path))
            w = math.exp(s)
            z += w
            for t, y in enumerate(path):
                by[t, y] += w
            for a, b in itertools.pairwise(path):
                pair[a, b] += w
        assert np.allclose(marginal[c, :n], by / z) and np.allclose(log_z[c], math.log(z))
        assert (marginal[c, n:] == 0).all()
        total_pairs += pair / z
    assert np.allclose(pairs, total_pairs)


def test_held_out_accuracy(spark):
    got = li.op9_language_id(spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def model(spark):
    rows = [(i, "der hund und die katze schlafen nicht " * (1 + i % 5), "de", "s") for i in range(40)]
    rows += [(100 + i, "the dog and the cat do not sleep " * (1 + i % 5), "en", "s") for i in range(40)]
    return li.train(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang")


def test_code_switched_text_is_labelled_word_by_word(spark):
    tagger = li.Tagger(model(spark))
    mixed = "the dog and the cat " * 6 + "und die katze schlafen nicht " * 2
    share = tagger.shares([li.words_of(mixed)])[0]
    assert tagger.model.labels == ["de", "en"] and abs(share[0] - 10 / 40) < 0.1
    assert share.sum() == np.float64(1) or abs(share.sum() - 1) < 1e-9


def test_texts_without_letters_long_texts_and_other_columns(spark):
    schema = "doc_id long, text string, lang_pred_ string, n int"
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "12 34 !! __", "a", 1), (4, "the cat", "a", 1), (4, "the cat", "a", 1), (None, "die katze " * 100_000, "a", 1)]
    got = li.identify(spark.createDataFrame(rows, schema), model(spark), "text")
    assert got.columns == ["doc_id", "text", "lang_pred_", "n", "lang_pred", "score"]
    by = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert by == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")]


def test_random_letters_are_foreign_to_every_language(spark):
    import random

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null")
    learned = li.train(docs.where(~li.held_out("doc_id")), "doc_id", "text", "lang")
    clean = li.identify(docs.where(li.held_out("doc_id")), learned, "text", common_col="common").collect()
    assert sum(r.common >= cp.LEAST_COMMON for r in clean) >= 0.98 * len(clean)
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    junk = spark.createDataFrame([(words(rng.choice([60, 400])),) for _ in range(60)], "text string")
    assert li.identify(junk, learned, "text", common_col="common").where(F.col("common") >= cp.LEAST_COMMON).count() <= 3  # of 60, learned from 150 texts


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, "text", "x")], "doc_id long, text string, score string")
    with pytest.raises(ValueError):
        li.identify(df, model(spark), "text")
    with pytest.raises(ValueError):
        li.identify(df.drop("score"), model(spark), "text", lang_col="doc_id")


def test_blocks_of_chains_learn_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [[f"{y}{w}" for w in rng.integers(0, 30, 90)] for y in "ab" for _ in range(8)]
    tags = [0] * 8 + [1] * 8
    even = np.zeros((li.LEXICON, 2))
    whole = li.fit(texts, tags, ["a", "b"], even, even)
    monkeypatch.setattr(li, "BLOCK_CHAINS", 2)
    blocks = li.fit(iter(texts), tags, ["a", "b"], even, even)
    assert np.allclose(whole.weights, blocks.weights) and np.allclose(whole.moves, blocks.moves)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, "text", None, "s"), (2, None, "en", "s")], SCHEMA)
    learned = li.train(empty, "doc_id", "text", "lang")
    assert learned.labels == []
    assert [r.lang_pred for r in li.identify(empty, learned, "text").collect()] == ["und", "und"]
    one = li.train(spark.createDataFrame([(1, "some words", "en", "s")], SCHEMA), "doc_id", "text", "lang")
    assert [(r.lang_pred, r.score) for r in li.identify(empty, one, "text").collect()] == [("en", 1.0), ("und", 0.0)]
    assert li.identify(empty.limit(0), one, "text").count() == 0
