"""Jaccard join, substring dedup and line dedup against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import components_of

from textmill.llm import jaccard_join, line_dedup
from textmill.llm.jaccard_join import bands, jaccard_classes
from textmill.llm.line_dedup import dedup_lines, edit_distance_within
from textmill.llm.substring_dedup import dedup_substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def corpus(rng, n=120):
    """Texts with exact copies, copies of a few changed words, a hot passage, and odd cases."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 9, 20, 60, 150, 400]))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        texts.append(words)
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    for _ in range(60):  # a large group of near copies
        copy = list(texts[0] * 20)[:200]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(copy)
    joined = [" ".join(t) if rng.random() < 0.8 else "\n".join(t).upper() for t in texts]
    rows = list(enumerate(joined + [None, "", "  \n", "a b c", "A B C", "a b", "x " * 30_000]))
    rng.shuffle(rows)
    return rows


def sets(rows, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(lower))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, num):
    rows = corpus(random.Random(k))
    own = sets(rows, k)
    links = []
    for a, b in itertools.combinations(sorted(own), 2):
        common = len(own[a] & own[b])
        if own[a] and own[b] and 100 * common >= num * (len(own[a]) + len(own[b]) - common):
            links.append((a, b))
    want = components_of(own, links)
    got = jaccard_classes(table(spark, rows), "doc_id", "text", k, num).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in own.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_jaccard_edges(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e"), (3, None), (4, None), (0, "")]
    got = jaccard_classes(table(spark, rows), "doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.doc_id is not None and r.doc_id != 0) == [
        (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)
    ]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]
    assert jaccard_classes(table(spark, []), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        jaccard_classes(table(spark, []), "doc_id", "text", 4, 100)


def test_bands_leave_parts_over():
    last, most, parts, weak = bands(85, 100)
    assert (parts == most + 1 + weak).all() and (last[1:] > last[:-1]).all()
    assert all(int(b) * 100 // 85 <= int(a) for b, a in zip(last[20:60], last[21:61]))


def test_texts_that_share_a_passage_are_not_read_again(spark, monkeypatch):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        words[i:i] = passage
        rows.append((i, " ".join(words)))
    rows.append((80, rows[7][1] + " and more"))
    seen, written = [], jaccard_join.written

    def counted(df):
        seen.append((set(df.columns), out := written(df)))
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    got = {r.doc_id: r.component_id for r in jaccard_classes(table(spark, rows), "doc_id", "text", 5, 80).collect()}
    assert got == {i: i for i in range(80)} | {80: 7}
    assert sum(df.count() for names, df in seen if "text" in names) == 2
    assert {r.id for names, df in seen if names == {"key", "id", "rep"} for r in df.collect()} == {7, 80}


@pytest.mark.parametrize("num", [80, 85])
def test_partners_share_more_keys_than_they_can_do_without(num):
    rng = np.random.default_rng(num)
    last, most, *_ = bands(num, 100)
    for n in [*range(4, 70), *rng.integers(70, 1500, 60)]:
        # Two sets at the threshold or just above it: b has n elements, a has least of them and no others.
        least = -(-int(n) * num // 100)
        for extra in {0, (n - least) // 2}:
            b = rng.integers(0, 1 << 63, n).astype(np.uint64)
            a = np.concatenate((b[: least + extra], rng.integers(0, 1 << 63, extra // 3).astype(np.uint64)))
            common = least + extra
            if len(a) > n or 100 * common < num * (len(a) + n - common):
                continue
            sizes = np.array([len(a), n])
            owner, value = np.repeat([0, 1], sizes), np.concatenate((np.sort(a), np.sort(b)))
            spare = jaccard_join._spare(owner, value, sizes, num, 100)
            band = np.searchsorted(last, sizes)
            scheme = np.full(2, band.min())
            assert band[1] <= band[0] + 1
            if not most[scheme[0]]:
                continue
            key, who = jaccard_join._scheme_keys(owner, value, sizes, np.ones(2, bool), scheme, num, 100)
            assert (key & 1 == scheme[0] & 1).all()
            assert len(set(key[who == 0]) & set(key[who == 1])) > spare[scheme[0] & 1].max()


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_runs_across_batches(monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "MANY", 4)
    keys = np.repeat(np.arange(12), [1, 2, 1, 3, 9, 1, 4, 1, 5, 2, 1, 7])
    ids = np.arange(len(keys))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(ids[i : i + size])], ["key", "id"])
        for i in range(0, len(keys), size)
    ]
    got = [r for b in jaccard_join._runs(iter(batches)) for r in b.to_pylist()]
    times = np.bincount(keys)[keys]
    assert [(r["key"], r["id"], r["times"]) for r in got] == [
        (k, i, min(t, 4)) for k, i, t in zip(keys, ids, times, strict=True) if t > 1
    ]
    assert not list(jaccard_join._runs(iter([])))


def removed(rows, size=13):
    words = {i: WORDS.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][j : j + size]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("size", [13, 5])
def test_substrings(spark, size):
    rows = corpus(random.Random(9))
    got = dedup_substrings(table(spark, rows), "doc_id", "text", size).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(rows, size)


def test_substring_edges(spark):
    text = " ".join(f"v{i}" for i in range(20))
    got = dedup_substrings(table(spark, [(7, text), (7, text), (None, text), (8, "x " + text), (9, None)]), "doc_id", "text").collect()
    assert sorted((r.id or 0, r.n_words, r.n_removed) for r in got) == [(0, 20, 0), (7, 20, 0), (7, 20, 0), (8, 21, 20), (9, 0, 0)]
    assert dedup_substrings(table(spark, []), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        dedup_substrings(table(spark, []), "doc_id", "text", 12)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2, 4])
def test_edit_distance(spark, tau):
    from pyspark.sql import functions as F

    rng = random.Random(tau)
    rows = []
    while len(rows) < 1500:
        a = [rng.choice("ab語😀") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, tau + 2)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("ab語😀")] * rng.randint(0, 1)
        if abs(len(a) - len(b)) <= tau:
            rows.append(("".join(a), "".join(b), distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    got = df.withColumn("g", edit_distance_within(F.col("a"), F.col("b"), tau))
    assert got.where(f"(d <= {tau} and g <> d) or (d > {tau} and g <= {tau})").count() == 0


def noisy_lines(rng):
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(24, 70))).strip().ljust(24, "z") for _ in range(60)]
    hot = "this very line stands in most of the documents, more or less"
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(base) if rng.random() < 0.7 else hot)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(line))
                line[at : at + rng.randint(0, 1)] = [rng.choice("XYZ")] * rng.randint(0, 1)
            lines.append("".join(line))
        lines += rng.choice([[], [""], ["short"], ["short", "  "]])
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    rng.shuffle(docs)
    return docs


def kept_lines(docs, tau=2, least=24):
    places = {}
    for i, t in sorted(docs):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                places.setdefault(line, (i, n))
    late = set()
    long = [x for x in places if len(x) >= least]
    for a, b in itertools.combinations(long, 2):
        if abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
            late.add(max(a, b, key=places.get))
    return {
        i: "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or (places[x] == (i, n) and x not in late))
        for i, t in docs
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, monkeypatch, seed):
    monkeypatch.setattr(line_dedup, "HEAVY", 100)
    docs = noisy_lines(random.Random(seed))
    got = dedup_lines(table(spark, docs), "doc_id", "text").collect()
    assert {r.doc_id: r.text for r in got} == kept_lines(docs)
    assert sum(r.n_removed for r in got) > 50


def test_short_lines_of_query_and_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    docs = [(-3, "Page 1 of 9\na line of 23 characters."), (-2, "Page 12 of 9\na line of 24 characterss."), (-1, "x\nkeep it")]
    for i in range(60):
        lines = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([1, 2, 3, 4, 7, 9, 11, 14, 23, 25]))) for _ in range(4)]
        docs.append((i, "\n".join([*lines, lines[0] + "x", lines[1][1:]])))
    want = kept_lines(docs, least=1)
    assert want[-2] == ""
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "length(text) n_chars").write.parquet(path)
    got = line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    left = corpus_pipeline.lines(spark, spark.read.parquet(path), "").collect()
    assert {r.doc_id: r.text for r in left} == {i: t for i, t in want.items() if t.strip()}


def test_line_edges(spark):
    line = "a line of more than two dozen characters"
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, "\n" + line + "\n\n" + line), (5, "tiny\ntiny"), (6, "x" * 50_000)]
    got = dedup_lines(table(spark, rows), "doc_id", "text")
    assert got.columns == ["doc_id", "text", "key", "n", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.n_lines, r.n_removed, (r.text or "None")[:45]) for r in got.collect()) == [
        (1, 0, 0, "None"), (2, 1, 0, "None"), (3, 1, 0, line), (3, 1, 0, line), (4, 4, 2, "\n"), (5, 2, 1, "tiny"),
        (6, 1, 0, "x" * 45),
    ]
    assert dedup_lines(table(spark, []), "doc_id", "text").count() == 0


def test_native_operators_run_no_python(spark):
    from textmill.llm.mixing import mix_sources
    from textmill.llm.personal_data import find_personal_data

    docs = table(spark, [(1, "a line of text"), (2, "another one")])
    for df in (
        dedup_lines(docs, "doc_id", "text"),
        mix_sources(docs, "doc_id", "text", "key"),
        find_personal_data(docs, "text", ["doc_id"]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
