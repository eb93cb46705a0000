import itertools
import math

import numpy as np
import pytest
from conftest import SMALL
from llm.conftest import components_of
from pyspark.sql import functions as F

from textmill.llm import lattice_dedup, topk
from textmill.llm.lattice_dedup import decode, roots, similar_vectors
from textmill.llm.topk import top_products

NAN, INF = float("nan"), float("inf")
ODD = [
    (900, None, 1), (901, [0.0] * 16, 1), (902, [NAN] + [1.0] * 15, 1), (903, [INF] + [1.0] * 15, 1),
    (904, [None] + [1.0] * 15, 1), (905, [], 1), (906, [1.0] * 16, None), (None, [1.0] * 16, 1), (907, [1.0] * 16, 1),
    (908, [1.0] * 15, 1), (909, [-0.0] * 15 + [1.0], 1), (910, [0.0] * 15 + [1.0], 1), (911, [1e30] * 16, 1),
]
SCHEMA = "vec_id long, embedding array<float>, label int, links string, component string"


def planted(rng, dim=16, n=120):
    rows = []
    for i in range(n):
        base = rng.normal(size=dim)
        for j in range(rng.integers(1, 5)):
            noise = rng.normal(size=dim) * np.linalg.norm(base) / math.sqrt(dim) * rng.choice([0, 0.1, 0.18, 0.3])
            rows.append((len(rows), (base + noise).astype(np.float32).tolist(), int(i % 3)))
    hot = rng.normal(size=dim)
    for _ in range(150):
        rows.append((len(rows), (hot + rng.normal(size=dim) * 0.08).astype(np.float32).tolist(), 1))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.98):
    found = {}
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and usable(v)]
    links = []
    for (i, v, a), (j, u, b) in itertools.combinations(good, 2):
        if a == b and len(v) == len(u):
            scale = np.abs(v).max() , np.abs(u).max()
            v1, u1 = v / scale[0], u / scale[1]
            if v1 @ u1 / (np.linalg.norm(v1) * np.linalg.norm(u1)) >= least:
                links.append((i, j))
    ids = {i for i, _, _ in rows if i is not None}
    lead = components_of(ids, links)
    count = dict.fromkeys(ids, 0)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    for i in ids:
        found[i] = (count[i], lead[i], lead[i] == i)
    return found


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    got = decode(x)
    shell = np.concatenate([roots(), np.array([2.0 * s * np.eye(8)[i] for i in range(8) for s in (1, -1)])])
    own = ((x - got) ** 2).sum(axis=1)
    for step in shell:
        assert (own <= ((x - got - step) ** 2).sum(axis=1) + 1e-9).all()
    assert len(roots()) == 240 and ((2 * got) % 1 == 0).all()


@pytest.mark.parametrize("blocks", [1, 2, 3])
@pytest.mark.parametrize("dim", [4, 8, 16, 32, 64, 384])
@pytest.mark.parametrize("least", [0.9, 0.98])
def test_pairs_at_the_least_cosine_meet(dim, blocks, least):
    rng = np.random.default_rng(7)
    a = lattice_dedup._unit(rng.normal(size=(400, dim)))
    b = rng.normal(size=(400, dim))
    b = lattice_dedup._unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = least * a + math.sqrt(1 - least * least) * b
    x, y = (lattice_dedup.cells(v, np.zeros(400, np.int64), blocks, least) for v in (a, b))
    met = (x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)
    assert met.any(axis=1).mean() >= 0.995


def test_cells_tell_vectors_apart_at_many_dimensions():
    for dim in (16, 64, 384, 1024):
        v = lattice_dedup._unit(np.random.default_rng(3).normal(size=(2000, dim)))
        assert len(np.unique(lattice_dedup.cells(v, np.zeros(2000, np.int64), 1)[:, 0, 0])) > 1800


@pytest.mark.parametrize("blocks", [1, 2])
def test_links_and_components(spark, monkeypatch, blocks):
    monkeypatch.setattr(lattice_dedup, "CHUNK", 32)
    rows = planted(np.random.default_rng(2)) + ODD
    got = {
        r.vec_id: (r.n_links, r.component_id, r.kept)
        for r in similar_vectors(table(spark, rows), "vec_id", "embedding", "label", blocks=blocks).collect()
    }
    assert got.pop(None) == (0, None, False)
    want = brute(rows)
    if blocks == 1:
        assert got == want
    else:  # longer keys meet less often, but never link what is not close
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) > 0.98 * sum(w[0] for w in want.values())


def test_no_vectors(spark):
    assert similar_vectors(table(spark, []), "vec_id", "embedding", "label").count() == 0
    assert top_products(table(spark, []), "vec_id", "embedding").count() == 0


def best(rows, k=10):
    def ints(v):
        return [math.floor(1024 * x) for x in v]

    good = [(i, ints(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % 100 == 0:
            most = (1 << 63) - 1
            scores = sorted((-max(-most, min(most, sum(a * b for a, b in zip(v, u)))), i) for i, u in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 32)
    monkeypatch.setattr(topk, "QUERY_BATCH", 2)
    monkeypatch.setattr(topk, "ROWS", 16)
    rows = planted(np.random.default_rng(4)) + [r for r in ODD if r[0] != 911]
    rows += [(i, [float(i % 3)] * 16, 0) for i in range(1000, 1060)]  # ties
    got = top_products(table(spark, rows), "vec_id", "embedding").collect()
    assert sorted(map(tuple, got)) == best(rows)


def test_files_of_one_task_come_in_any_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "SEEDS", 1)  # too few to start from, so that a task's own rows set the floor
    monkeypatch.setattr(topk, "ROWS", 100)
    rng = np.random.default_rng(6)
    scale = [1.0] * 1600 + [0.05] * 1000 + [8.0] * 30
    rows = [(i, (rng.normal(size=16) * x).astype(np.float32).tolist(), 0) for i, x in enumerate(scale)]
    real = topk.written

    def in_files(df):
        """Files that Spark reads by falling size: middling vectors, short ones, then the longest."""
        if "length" not in df.columns:
            return real(df)
        path = str(tmp_path / "files")
        for low, high in ((1_000, 15_000), (0, 1_000), (15_000, 1e9)):
            part = df.where(f"length >= {low} and length < {high}").coalesce(1)
            part.sort(F.col("length").desc(), "id").write.mode("append").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    monkeypatch.setattr(topk, "written", in_files)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
        got = top_products(frame, "vec_id", "embedding", every=100).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(map(tuple, got)) == best(rows)


def test_few_candidates_and_large_numbers(spark):
    rows = [(0, [3.0, -1e9], 0), (1, [1e9, 1e9], 0), (100, [2.0, 1e9], 0)]
    got = top_products(table(spark, rows), "vec_id", "embedding").collect()
    assert sorted(map(tuple, got)) == best(rows)


def test_all_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, topk.op10_exact_topk(spark, SMALL).collect())) == best(rows)
