"""Exact top-k search by inner product over vectors sorted by length.

Candidates are sorted by descending length over the whole table and rotated by the
eigenvectors of their Gram matrix (the right singular vectors of the table), so that the
first coordinates carry most of a product. A task walks its candidates in blocks. A query
whose k-th score exceeds its length times that of the block's longest candidate skips the
block (Cauchy-Schwarz); a later block may hold longer candidates, as a task reads several
files and not in their order. Of the others, the partial product over the first coordinates
plus the product of the remaining lengths bounds the score, and only pairs whose bound
reaches the query's k-th score are scored, in exact integers. Every query starts from its
k-th score among the longest candidates.

Queries travel in batches of about ``QUERY_BATCH``, a bounded broadcast; a task returns at
most k rows per query, and a window picks the best k of all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import sql
from textmill.llm.shared import ship, written

QUERY_BATCH = 8192
SEEDS = 2048
HEAD_SHARE = 4
ROWS = 4096


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _gram(dim: int):
    """Each task's share of the Gram matrix, one row per entry."""

    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _padded(batch.column(0), dim)
            total += x.T @ x
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.reshape(-1))], ["i", "j", "x"]
        )

    return run


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; doubles hold them while they stay below 2 ** 53."""
    size = q.shape[-1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if size < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in c]
    top = (1 << 63) - 1
    return np.array(
        [[max(-top, min(top, sum(x * y for x, y in zip(a, b, strict=True)))) for b in whole[1]] for a in whole[0]],
        np.int64,
    ).reshape(len(q), len(c))


class _Best:
    """The best k candidates of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        use = scores >= self.floor[query]
        scores, ids = scores[use], ids[use]
        if len(scores) > 4 * self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= edge], ids[scores >= edge]
        if not len(scores):
            return
        merged = self.found[query] + list(zip((-scores).tolist(), ids.tolist(), strict=True))
        self.found[query] = sorted(merged)[: self.k]
        if len(self.found[query]) == self.k:
            self.floor[query] = max(self.floor[query], -self.found[query][-1][0])


def _walked(shared, k: int, rotation: np.ndarray):
    """Top k of the task's candidates for each query of the batch."""

    def run(batches):
        number, serial, q, floor = shared.value
        dim = rotation.shape[0]
        head = max(1, dim // HEAD_SHARE)
        turned = q @ rotation
        length = np.sqrt((q * q).sum(axis=1))
        tail = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        best = _Best(len(q), k, floor)
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.slice(low, ROWS)
                ids, c = part.column(0).to_numpy(), _padded(part.column(1), dim)
                long = np.sqrt((c * c).sum(axis=1))
                slack = 1e-6 * (1 + length * long.max(initial=0))
                # Lengths fall within a file only: who cannot reach the longest here may reach a later one.
                active = np.flatnonzero(length * long.max(initial=0) + slack >= best.floor)
                if not len(active):
                    continue
                spin = c @ rotation
                rest = np.sqrt((spin[:, head:] ** 2).sum(axis=1))
                for at in range(0, len(active), 256):
                    some = active[at : at + 256]
                    bound = turned[some, :head] @ spin[:, :head].T + np.outer(tail[some], rest)
                    may = bound + slack[some][:, None] >= best.floor[some][:, None]
                    need = np.flatnonzero(may.any(axis=0))
                    if not len(need):
                        continue
                    scores = _exact(q[some], c[need])
                    may = may[:, need] & (ids[need][None, :] != number[some][:, None])
                    for r, query in enumerate(some):
                        if may[r].any():
                            best.add(query, scores[r][may[r]], ids[need][may[r]])
        rows = [(int(serial[i]), int(number[i]), b, -a) for i, f in enumerate(best.found) for a, b in f]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["serial", "query_id", "vec_id", "score"]
            )

    return run


def _start(q: np.ndarray, number: np.ndarray, seeds: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A score at least k candidates reach, where the seeds hold that many."""
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(q), 512):
        scores = _exact(q[at : at + 512], seeds).astype(np.float64)
        scores[ids[None, :] == number[at : at + 512][:, None]] = -np.inf
        if scores.shape[1] >= k:
            floor[at : at + 512] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return floor


def top_products(vectors: DataFrame, id_col: str, vector_col: str, k: int = 10, every: int = 100, factor: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each query.

    Components become ``floor(factor * x)``. Queries are the rows whose id ``every``
    divides, candidates all rows of another id; ties go to the smaller id. A row with a null id, a null
    vector or one with a null or non-finite component takes no part. A shorter vector
    counts as padded with zeros. Repeated rows are candidates each on their own, and one
    query. Scores beyond 63 bits stop there. No queries or candidates give an empty table.
    """
    ship()
    spark = vectors.sparkSession
    numbers = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("double"))
    finite = F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), numbers.alias("v")
    )
    schema = "serial bigint, query_id bigint, vec_id bigint, score bigint"
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("length", size)
    facts = rows.agg(F.max(F.size("v")), F.count("*")).first()
    dim, count = max(1, facts[0] or 0), facts[1]
    gram = np.zeros((dim, dim))
    for r in rows.select("v").mapInArrow(_gram(dim), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        gram[r.i, r.j] = r.x  # dim * dim rows, whatever the number of vectors
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy()
    ordered = written(rows.repartitionByRange(F.col("length").desc()).sortWithinPartitions(F.col("length").desc(), "id"))
    top = ordered.orderBy(F.col("length").desc(), "id").limit(SEEDS).select("id", "v").toArrow().combine_chunks()

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(0, np.int64), np.zeros((0, dim))
        return table.column("id").to_numpy(), _padded(table.column("v").chunk(0), dim)

    seed_ids, seeds = arrays(top)
    queries = ordered.where(F.col("id") % every == 0).select("id", "v").distinct()
    queries = written(queries.withColumn("serial", F.xxhash64("id", "v")))
    parts = max(1, math.ceil(queries.count() / QUERY_BATCH))
    found = spark.createDataFrame([], schema)
    for part in range(parts if count else 0):
        batch = queries.where(F.pmod(F.xxhash64(F.lit("batch"), "serial"), F.lit(parts)) == part).toArrow().combine_chunks()
        if not len(batch):
            continue
        number, q = arrays(batch)
        floor = _start(q, number, seeds, seed_ids, k)
        shared = spark.sparkContext.broadcast((number, batch.column("serial").to_numpy(), q, floor))
        # No candidate shorter than this reaches the k-th score of any query; files are sorted by length.
        short = float(np.min((floor - 1) / np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-300), initial=np.inf))
        able = ordered.where(F.col("length") >= short * (1 - 1e-6)) if 0 < short < np.inf else ordered
        found = found.union(written(able.select("id", "v").mapInArrow(_walked(shared, k, rotation), schema)))
        shared.destroy()
    order = Window.partitionBy("serial", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every hundredth."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


QUERIES = {"op10_exact_topk": op10_exact_topk}
ORACLE = {"op10_exact_topk": sql.TOP_PRODUCTS}
