from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.llm.mixing import mix_sources, mixed_documents

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = total - sum(done.values())
        free = sum(weight[s] for s in names if s not in done)
        share = {s: left * weight[s] / free for s in names if s not in done}
        over = [s for s in share if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


def test_targets_and_copies(spark):
    rows = []
    for i in range(600):
        source = ["a", "b", None, "é", "Z", "c"][i % 6] if i % 3 else "a"
        rows.append((i, " ".join(["w"] * (1 + (i * 37) % 90)), source))
    rows += [(600, None, "a"), (601, "", "b"), (602, " \n", "empty"), (603, "x", "tiny"), (604, "w " * 5000, "c")]
    got = mix_sources(table(spark, rows), "doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = Counter()
    for i, _, s in rows:
        by[s] += size[i]
    want = targets(by)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.id] and r.source_size == by[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        taken[r.source] += r.taken
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 0.02 * goal + 30
    again = mix_sources(table(spark, rows), "doc_id", "text", "source").collect()
    assert sorted((r.id, r.copies) for r in got) == sorted((r.id, r.copies) for r in again)


def test_rates_are_an_exponential_tilt(spark):
    rows = [(i, "w " * (1 + i % 40), "ab"[i % 2]) for i in range(400)]
    got = mix_sources(table(spark, rows), "doc_id", "text", "source").where("rate < 3")
    import math

    slopes = {}
    for r in got.collect():
        slopes.setdefault(r.source, set()).add(round(math.log(r.rate) / r["size"], 9))
    assert all(len(s) == 1 for s in slopes.values())


def test_equal_documents_share_a_cell(spark, monkeypatch):
    from textmill.llm import mixing

    monkeypatch.setattr(mixing, "PART", 8)
    rows = [(i, "one two three", "a") for i in range(300)] + [(1000 + i, "x " * 9, "b") for i in range(100)]
    got = mix_sources(table(spark, rows), "doc_id", "text", "source").collect()
    for source, goal in targets({"a": 900, "b": 900}).items():
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - goal) <= 9
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1


def test_documents_are_repeated(spark):
    rows = [(i, f"w{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(60)] + [(5, "w5 " * 6, "b"), (5, "w5 " * 6, "b")]
    docs = table(spark, rows)
    plan = Counter()
    for r in mix_sources(docs, "doc_id", "text", "source").collect():
        plan[r.id] += r.copies
    out = mixed_documents(docs, "doc_id", "text", "source")
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +plan


def test_empty_and_wordless_tables(spark):
    assert mix_sources(table(spark, []), "doc_id", "text", "source").count() == 0
    got = mix_sources(table(spark, [(1, None, None), (2, "", "a")]), "doc_id", "text", "source").collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2
    assert mixed_documents(table(spark, []), "doc_id", "text", "source").count() == 0


def test_both_joins_share_one_shuffle_of_the_texts(spark, tmp_path):
    rows = [(i, f"w{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(60)] + [(5, "w5 " * 6, "b")] * 2
    table(spark, rows).write.parquet(f"{tmp_path}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = mixed_documents(spark.read.parquet(f"{tmp_path}/docs"), "doc_id", "text", "source")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") == 1, plan
