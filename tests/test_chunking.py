import os
import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions.tokens import SubwordCounter, WhitespaceCounter
from textmill.operators.chunk_exact import chunk_exact, snap_targets, walk
from textmill.operators.chunk_pack import pack_text
from textmill.operators.documents import block_dedupe, chunk_documents, page_concat
from textmill.options import JobOptions, Limits
from textmill.schemas import CHUNKS

from test_text import boundaries


def random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    vocab = ["alpha", "be", "c", "delta", "dr.", "end.", "stop!", "why?", "x\ny", "x", "longword"]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 90))).strip() for _ in range(n)]


def greedy(text: str, limit: int, overlap: int) -> list[str]:
    """Pack mode by hand: sentences, long ones in windows, first fit."""
    text = text.strip()
    if not text:
        return []
    if len(text.split()) <= limit:
        return [text]
    budget, cut = limit - overlap, [0, *sorted(set(boundaries(text)))]
    cut = cut if cut[-1] == len(text) else [*cut, len(text)]
    pieces = []
    for a, b in zip(cut, cut[1:]):
        w = text[a:b].split()
        pieces += [text[a:b]] if len(w) <= budget else [" " + " ".join(w[i : i + budget]) for i in range(0, len(w), budget)]
    runs, room = [[]], limit
    for p in pieces:
        if runs[-1] and sum(len(q.split()) for q in runs[-1]) + len(p.split()) > room:
            runs.append([])
            room = budget
        runs[-1].append(p)
    fresh = ["".join(r).strip() for r in runs]
    return [
        f if i == 0 or not overlap else " ".join(fresh[i - 1].split()[-overlap:]) + " " + f for i, f in enumerate(fresh)
    ]


@pytest.mark.parametrize("limit,overlap", [(12, 0), (12, 5), (1, 0), (30, 29)])
def test_pack_matches_first_fit(spark, limit, overlap):
    df = spark.createDataFrame([(t,) for t in [*random_texts(60, 1), "", "  \n "]], "t string")
    for r in df.select("t", pack_text(F.col("t"), limit, overlap).alias("c")).collect():
        assert [c.text for c in r.c] == greedy(r.t, limit, overlap), r.t
        assert all(c.token_count == len(c.text.split()) <= limit for c in r.c)
        assert sum(c.fresh_tokens for c in r.c) == len(r.t.split())


def test_pack_checks_its_budget():
    for limit, overlap in [(0, 0), (5, 5), (5, -1)]:
        with pytest.raises(ValueError):
            pack_text(F.lit("x"), limit, overlap)


def by_the_rules(text: str, limit: int, overlap: int) -> list[str]:
    """Exact mode with plain word counts, one position at a time."""
    count = lambda s: max(1, len(s.split()))
    ends, out, start = sorted(set(boundaries(text))), [], 0
    while start < len(text):
        rest = text[start:]
        if count(rest) <= limit:
            return [*out, rest.strip()]
        size = min(int(limit * (len(rest) / count(rest))), len(rest))
        for _ in range(21):
            goal = start + size
            hits = [e for e in ends if start < e <= goal]
            if hits:
                end = hits[-1]
            elif goal >= len(text):
                end = len(text)
            else:
                spaces = [p for p in range(start + 1, goal + 1) if text[p] == " "]
                ahead = [p for p in range(goal, len(text)) if text[p] == " "]
                end = spaces[-1] if spaces else (ahead[0] if ahead else len(text))
            if end <= start:
                end = min(start + max(1, size), len(text))
            if count(text[start:end].strip()) <= limit:
                piece = text[start:end].strip()
                break
            size = max(1, int(size * 0.9))
        else:
            piece = " ".join(rest.split()[:limit])
            end = start + len(piece)
            while end < len(text) and text[end] == " ":
                end += 1
        if piece:
            out.append(piece)
        back = int(overlap * (min(end, 500) / count(text[max(0, end - 500) : end]))) if overlap and end < len(text) else 0
        start = max(end - back, start + 1)
    return out


@pytest.mark.parametrize("limit,overlap", [(12, 0), (12, 4), (3, 2)])
def test_exact_follows_the_rules(spark, limit, overlap):
    texts = [t for t in random_texts(40, 7) if t] + ["a\nb\nc\nd e f " * 9, "word " * 50, "\n".join(["line"] * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "source_file string, text string")
    got = chunk_exact(df, limit, overlap).collect()
    for i, text in enumerate(texts):
        mine = sorted((r.chunk_index, r.text) for r in got if r.source_file == str(i))
        assert [t for _, t in mine] == by_the_rules(text.strip(), limit, overlap)


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_exact_with_subwords(spark):
    counter = SubwordCounter(TOKENIZER)
    texts = ["Tokenization of unusual wordings. " * 40, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "source_file string, text string")
    got = chunk_exact(df, 64, 8, counter).withColumn("again", counter.count("text")).orderBy("source_file", "chunk_index").collect()
    assert len(got) > 5 and all(r.token_count <= 64 and r.again == r.token_count for r in got)
    cut = df.select(counter.truncate("text", 5).alias("t")).select(counter.count("t").alias("n")).collect()
    assert [r.n for r in cut] == [5, 1]


def test_exact_hands_back_small_batches():
    from textmill.operators.chunk_exact import SLICE, _walked

    words = "word " * 400
    texts = [words if i % 2 else words * 8 for i in range(4000)]
    batch = pa.record_batch(
        {
            "source_file": [str(i) for i in range(len(texts))],
            "text": [t.strip() for t in texts],
            "token_count": pa.array([len(t.split()) for t in texts], pa.int32()),
            "lengths": pa.array([None if i % 2 else [len(t) - 1] for i, t in enumerate(texts)], pa.list_(pa.int32())),
        }
    )
    for failures in (False, True):
        run = _walked(["source_file"], 512, 100, WhitespaceCounter().meter(), failures)
        sizes, found = [], {}
        for got in run(iter([batch])):
            sizes.append(got.nbytes)
            for r in got.select(["source_file", "chunk_index"]).to_pylist():
                found.setdefault(r["source_file"], []).append(r["chunk_index"])
        assert batch.nbytes > 8 * SLICE and max(sizes) < 1.5 * SLICE
        # Every document once, whole where it fits, else all of its chunks in order.
        assert len(found) == len(texts) and all(v == list(range(8 if int(k) % 2 == 0 else 1)) for k, v in found.items())


def test_exact_passes_columns_on(spark):
    long, schema = "word " * 40, "source_file string, text string, n int, at timestamp, tags array<string>"
    at = datetime(2024, 2, 29, 12, 30)
    df = spark.createDataFrame([("a", "short", None, at, ["x"]), ("b", long, 3, None, []), ("c", " ", 1, at, None)], schema)
    got = chunk_exact(df, 30, 0, WhitespaceCounter(), "n", "at", "tags", failures=True).orderBy("source_file", "chunk_index").collect()
    assert [(r.source_file, r.n, r.at, r.tags, r.chunk_index, r.token_count, r.failure) for r in got] == [
        ("a", None, at, ["x"], 0, 1, None),
        ("b", 3, None, [], 0, 30, None),
        ("b", 3, None, [], 1, 10, None),
    ]


def test_one_long_word_stays_whole():
    text = "x" * 50 + " y"
    meter = lambda t: (lambda a, b: b - a)  # noqa: E731 - every character is a token
    pieces = [c for c, _ in walk(text, np.array([], dtype=np.int64), 10, 0, meter)]
    assert pieces[0] == "x" * 50 and pieces[-1] == "y"


def test_snap_targets(spark):
    bounds = spark.createDataFrame([("a", 5), ("a", 12), ("a", 30)], "source_file string, bound int")
    targets = spark.createDataFrame(
        [("a", 0, 4), ("a", 0, 5), ("a", 5, 11), ("a", 5, 12), ("a", 12, 100), ("b", 0, 9)], "source_file string, start int, target int"
    )
    got = {(r.source_file, r.start, r.target): r.snapped for r in snap_targets(bounds, targets).collect()}
    assert got == {("a", 0, 4): None, ("a", 0, 5): 5, ("a", 5, 11): None, ("a", 5, 12): 12, ("a", 12, 100): 30, ("b", 0, 9): None}


def test_chunk_schema(spark):
    df = spark.createDataFrame([("f", "One. Two.", 7)], "source_file string, text string, k int")
    for mode in ("pack", "exact"):
        got = chunk_documents(df, JobOptions(chunk_mode=mode), "k")
        assert [(f.name, f.dataType) for f in got.schema][:-1] == [(f.name, f.dataType) for f in CHUNKS]
        row = got.collect()[0]
        assert row.sentence_aware and not row.is_tabular and row.k == 7 and row.token_count == 2


def test_pages_and_blocks(spark):
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("d", 3, ""), ("e", 1, "x" * 50)], "doc string, page_no int, text string")
    good, bad = page_concat(pages, limits=Limits(max_file_bytes=40))
    assert [tuple(r) for r in good.collect()] == [("d", "one\ntwo")]
    assert [(r.source_file, r.error_code) for r in bad.collect()] == [("e", "FILE_TOO_LARGE")]

    blocks = [("paragraph", 0, "p "), ("paragraph", 1, "p "), ("paragraph", 2, " "), ("cell", 0, " c "), ("cell", 1, "p "), ("cell", 2, "c"), ("cell", 3, "a")]
    df = spark.createDataFrame([("d", *b) for b in blocks], "doc string, kind string, ord int, text string")
    # The stripped cell "p" differs from the unstripped paragraph "p ".
    assert block_dedupe(df)[0].collect()[0].text == "p \np \nc\np\na"


def test_options_are_enforced():
    for wrong in (
        {"max_tokens": 0}, {"max_tokens": 40000}, {"overlap": -1}, {"overlap": 512}, {"normalization": "title"},
        {"response_format": "xml"}, {"prefix_mode": "doc"}, {"embedding_batch_size": 513}, {"values_only_threshold": 11},
        {"min_cols_for_table": 0}, {"counter": SubwordCounter("x")},
    ):
        with pytest.raises(ValueError, match="INVALID_PARAMETER"):
            JobOptions(**wrong)
    assert JobOptions().counter == WhitespaceCounter()


def test_abbreviations_before_any_number_of_dots(spark):
    from textmill.functions.sentences import sentence_pieces

    rows = [(n, word) for n in (1, 2, 999, 1000, 1001, 5000) for word in ("dr", "xdr", "Şti")]
    df = spark.createDataFrame([(n, w, f"He {w}{'.' * n}) went. On.") for n, w in rows], "n int, w string, t string")
    for r in df.select("n", "w", sentence_pieces("t").alias("p")).collect():
        assert len(r.p) == (3 if r.w == "xdr" else 2), (r.n, r.w)


def test_packing_grows_with_the_text(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("d", "One two. " * n)], "source_file string, text string").cache()
        df.count()
        start = time.perf_counter()
        assert chunk_documents(df, JobOptions(max_tokens=2, overlap=0)).count() == n
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(40_000) < 8 * seconds(10_000) + 2


class Failing:
    """A counter whose tokenizer fails on some texts."""

    additive = False

    def count(self, c):
        from pyspark.sql import functions as F

        return F.size(F.split(c, " "))

    def meter(self):
        def make():
            def measure(text):
                if "boom" in text:
                    raise RuntimeError("boom")
                return lambda start, stop: len(text[start:stop].split())

            return measure

        return make


def test_one_bad_document_does_not_end_the_job(spark):
    from textmill.operators.documents import chunk_documents_checked

    docs = [("good", "One two three. " * 20), ("bad", "boom two three. " * 20), ("short", "One.")]
    df = spark.createDataFrame(docs, "source_file string, text string")
    options = JobOptions(max_tokens=10, overlap=0, chunk_mode="exact", counter=Failing())
    chunks, bad = chunk_documents_checked(df, options)
    assert {r.source_file for r in chunks.collect()} == {"good", "short"}
    assert [(r.source_file, r.error_code) for r in bad.collect()] == [("bad", "PROCESSING_ERROR")]
    chunks, bad = chunk_documents_checked(df, JobOptions(max_tokens=10, overlap=0))
    assert {r.source_file for r in chunks.collect()} == {"good", "bad", "short"} and bad.count() == 0


def test_sentence_ends_of_many_sentences(spark):
    from textmill.operators.chunk_exact import sentence_ends

    text = "".join(f"Sentence {i}. " for i in range(1500))
    got = [r.bound for r in sentence_ends(spark.createDataFrame([("d", text)], "source_file string, text string")).collect()]
    ends, at = [], 0
    for i in range(1500):
        at += len(f"Sentence {i}.") + (i > 0)
        ends.append(at)
    assert got == ends
