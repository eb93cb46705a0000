"""Near duplicates of embeddings by E8 lattice hashing.

A unit vector is projected at random onto eight dimensions (or ``blocks`` times eight),
scaled and decoded to the nearest point of the lattice E8, in several tables. A vector
stands in its own cell of a table and visits the ``PROBES`` neighbouring cells whose
lattice points come next. Vectors that meet in a cell are compared by exact cosine.

The scale follows the number of dimensions and the least cosine, so that a pair just at that
cosine lies equally far apart in the lattice whatever they are: it shares or visits a cell of
one table with probability 0.86, 0.65 or 0.52 for one, two or three blocks, measured alike at
4 to 384 dimensions. ``TABLES`` has as many tables as leave it a chance of about 1e-5 to miss
all; closer pairs miss less. One block tells some 16,000 cells of a label apart, two four
million and three a hundred million; more blocks are taken from ``MANY`` vectors a label on.

Equal vectors of a label form one class with a count and travel once. A pair that meets in
several cells counts in one: the first table in which it meets, and there the cell the
smaller class visits, which every task can tell from the two vectors. So tasks send sums
and spanning links instead of pairs. Cells with many rows are cut into chunks of about
``CHUNK``; every pair of chunks is a group of its own.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import sql
from textmill.llm.shared import components, ship, written
from textmill.llm.words import U64, mix

TABLES = {1: 6, 2: 11, 3: 16}
PROBES = 4
MANY = (1 << 17, 1 << 25)
CHUNK = 512
SEED = 8


_KNOWN: dict[object, np.ndarray] = {}


def roots() -> np.ndarray:
    """The 240 shortest points of E8."""
    if "roots" not in _KNOWN:
        _KNOWN["roots"] = _roots()
    return _KNOWN["roots"]


def _roots() -> np.ndarray:
    whole = [
        np.bincount([i, j], weights=[a, b], minlength=8)
        for i, j in itertools.combinations(range(8), 2)
        for a in (1, -1)
        for b in (1, -1)
    ]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    near = np.round(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the integer points of even sum and those moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _projection(dim: int, table: int, blocks: int) -> np.ndarray:
    if (dim, table, blocks) not in _KNOWN:
        wide = max(dim, 8 * blocks)
        basis = np.linalg.qr(np.random.default_rng([SEED, table, dim]).normal(size=(wide, 8 * blocks)))[0]
        _KNOWN[dim, table, blocks] = basis[:dim]
    return _KNOWN[dim, table, blocks]


def scale(dim: int, blocks: int, least: float) -> float:
    """Factor that brings vectors at the least cosine to one distance in the lattice; 8 for 64 dimensions at 0.98."""
    return math.sqrt(max(dim, 8 * blocks) / blocks * 0.02 / (1 - least))


def cells(unit: np.ndarray, labels: np.ndarray, blocks: int, least: float = 0.98) -> np.ndarray:
    """Keys of each vector, by table: its own cell, then the cells it visits."""
    shell = roots()
    out = np.zeros((len(unit), TABLES[blocks], 1 + PROBES), U64)
    factor = scale(unit.shape[1], blocks, least)
    for t in range(TABLES[blocks]):
        points = unit @ _projection(unit.shape[1], t, blocks) * factor
        own = [decode(points[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        gain = np.concatenate([(points[:, 8 * b : 8 * b + 8] - own[b]) @ shell.T for b in range(blocks)], axis=1)
        # Rounded, so that a gain does not hang on the order of a sum; ties go to the first.
        nearest = np.argsort(-np.round(gain, 9), axis=1, kind="stable")[:, :PROBES]
        base = np.concatenate(own, axis=1)
        for k in range(1 + PROBES):
            place = base.copy()
            if k:
                at, which = np.divmod(nearest[:, k - 1], len(shell))
                for b in range(blocks):
                    here = at == b
                    place[here, 8 * b : 8 * b + 8] += shell[which[here]]
            key = mix(labels.astype(np.int64).view(U64) + U64(t * 7919 + unit.shape[1] * 104729))
            for column in (2 * place).astype(np.int64).T:
                key = mix(key * U64(31) + column.view(U64))
            out[:, t, k] = key
    return out.view(np.int64)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, by length of the vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = []
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        out.append((rows, flat[begin[rows][:, None] + np.arange(size)].astype(np.float64)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, keepdims=True)
    y = x / largest
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def _placed(blocks: int, least: float):
    def run(batches):
        for batch in batches:
            number, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, x in _matrix(batch.column(2)):
                keys = cells(_unit(x), label[rows], blocks, least)
                flat = keys.reshape(len(rows), -1)
                own = np.zeros(flat.shape, bool)
                own[:, :: 1 + PROBES] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.reshape(-1)), pa.array(np.repeat(number[rows], flat.shape[1])), pa.array(own.reshape(-1))],
                    ["key", "cid", "own"],
                )

    return run


def _linked(cid, label, copies, x, own, left, right, key, least, blocks):
    """Sums and spanning links of one group: ``left`` and ``right`` are its two chunks."""
    unit = _unit(x)
    cosine = unit[left] @ unit[right].T
    a, b = np.nonzero(cosine >= least)
    a, b = left[a], right[b]
    use = own[a] | own[b]
    if left[0] == right[0]:
        use &= cid[a] < cid[b]
    a, b = a[use], b[use]
    if not len(a):
        return None
    # Only vectors with a link need their cells in all tables.
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    cid, copies = cid[rows], copies[rows]
    keys = cells(unit[rows], label[rows], blocks, least)
    here = np.zeros(len(a), bool)
    for at in range(0, len(a), 50_000):
        p, q = a[at : at + 50_000], b[at : at + 50_000]
        small, large = np.where(cid[p] < cid[q], p, q), np.where(cid[p] < cid[q], q, p)
        to_large = (keys[small] == keys[large][:, :, :1]).any(axis=2)
        to_small = (keys[large] == keys[small][:, :, :1]).any(axis=2)
        table = (to_large | to_small).argmax(axis=1)
        row = np.arange(len(p))
        home = np.where(to_large[row, table], keys[large, table, 0], keys[small, table, 0])
        here[at : at + 50_000] = home == key
    a, b = a[here], b[here]
    if not len(a):
        return None
    links = np.bincount(a, copies[b], len(cid)) + np.bincount(b, copies[a], len(cid))
    lead = cid.copy()
    while True:
        before = lead.copy()
        low = np.minimum(lead[a], lead[b])
        np.minimum.at(lead, a, low)
        np.minimum.at(lead, b, low)
        if (lead == before).all():
            break
    hit = np.flatnonzero(links)
    return cid[hit], links[hit].astype(np.int64), lead[hit]


def _compared(least: float, blocks: int):
    """Streams rows sorted by (key, i, j); holds one batch and the group at its end."""
    names = ["key", "i", "j", "chunk", "own", "cid", "label", "copies", "v"]

    def groups(table: pa.Table, last: bool):
        """Results of the complete groups of a table, and the rows of the one that may go on."""
        column = {n: table.column(n).combine_chunks() for n in names}
        column = {n: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for n, c in column.items()}
        key, i, j, chunk, own, cid, label, copies = (column[n].to_numpy(zero_copy_only=False) for n in names[:8])
        new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        edges = np.concatenate(([0], new, [len(key)] if last else []))
        size, place, vectors = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), {}
        for rows, x in _matrix(column["v"]):
            vectors[x.shape[1]] = x
            size[rows], place[rows] = x.shape[1], np.arange(len(rows))
        found = []
        for lo, hi in zip(edges[:-1].astype(int), edges[1:].astype(int), strict=True):
            for length in np.unique(size[lo:hi]) if hi - lo > 1 else ():
                rows = lo + np.flatnonzero(size[lo:hi] == length)
                left, right = np.flatnonzero(chunk[rows] == i[lo]), np.flatnonzero(chunk[rows] == j[lo])
                if len(rows) > 1 and len(left) and len(right):
                    x = vectors[length][place[rows]]
                    part = _linked(cid[rows], label[rows], copies[rows], x, own[rows], left, right, key[lo], least, blocks)
                    if part:
                        found.append(part)
        return found, table.slice(int(edges[-1]))

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not len(table):
                continue
            found, rest = groups(table, False)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["cid", "links", "lead"])
        if rest is not None and len(rest) > 1:
            found, _ = groups(rest, True)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["cid", "links", "lead"])

    return run


def similar_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str, least: float = 0.98, blocks: int | None = None
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row of ``vectors``.

    Rows link when labels are equal and not null and the cosine in double precision is at
    least ``least``. A null, empty or zero vector, one with a null or non-finite component,
    a null label or a null id links with nothing: 0 links, its own id as component. Vectors
    of different lengths do not link. Repeated rows link like other equal vectors. Other
    columns are not read; an empty table gives an empty one. ``blocks`` joins that many E8
    cells, one to three, to a key; unless given it goes by the largest label.
    """
    if not 0 < least < 1:
        raise ValueError("the cosine must lie between 0 and 1")
    ship()
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    use = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("cid", F.when(use, F.xxhash64("label", "v")))
    classes = written(
        rows.where("cid is not null")
        .groupBy("cid", "label", "v")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    )
    if blocks is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        blocks = 1 + sum(most > many for many in MANY)
    placed = written(classes.select("cid", "label", "v").mapInArrow(_placed(blocks, least), "key bigint, cid bigint, own boolean"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("met")).where("met and n > 1")
    met = placed.join(sizes.select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "key")
    met = met.withColumn("chunk", F.pmod(F.xxhash64("cid", "key"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = met.withColumn("other", other).select(
        "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "own", "cid"
    )
    loaded = met.join(classes.select("cid", "label", "copies", "v"), "cid").select(
        "key", "i", "j", "chunk", "own", "cid", "label", "copies", "v"
    )
    streams = loaded.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = written(streams.mapInArrow(_compared(least, blocks), "cid bigint, links bigint, lead bigint"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cid").alias("a"), F.col("lead").alias("b")))
    grouped = classes.select("cid", "rep", "copies").join(labels, F.col("cid") == F.col("node"), "left")
    grouped = grouped.withColumn("group", F.coalesce("component", "cid"))
    least_id = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    info = grouped.join(least_id, "group").join(counts, "cid", "left").select(
        F.col("cid").alias("c"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return rows.join(info, F.col("cid") == F.col("c"), "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(False)).alias("kept"),
    )


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All vectors at a cosine of 0.98 within their labels."""
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
ORACLE = {"op3_embedding_near_dedup": sql.NEAR_VECTORS}
