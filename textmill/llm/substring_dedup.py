"""Exact substring dedup by fixed-block anchors.

A repeat of ``window`` words holds, wherever it lies, one whole block of the reference's
non-overlapping blocks of ``(window + 1) / 2`` words. The blocks of every document are the
index; every rolling window of that many words of every document probes it. A probe hits
where a smaller document has the block, and a block learns that a larger document probed
it. Hits of either kind are extended by all ``window``-word windows around them; a window
whose words also start in a smaller document is a repeat, and the union of these windows
are the maximal repeats.

Index and probes travel packed: a batch sends one row per bucket of hashes, with 32-bit
remainders, positions and run lengths of the documents. A bucket has about
``BUCKET_WORDS`` words at every input size. Within a bucket the index comes first, then
the probes stream past it, then the blocks once more to collect their notices, so that a
task holds the distinct blocks of one bucket, whatever the number of copies. A collision
of remainders only adds a candidate: windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import sql
from textmill.llm.shared import release, ship, written
from textmill.llm.words import U64, pieces, windows, words

BUCKET_WORDS = 2_000_000
LEAST_BUCKETS = 32
INDEX, PROBE, NOTICE = 0, 1, 2
PACKED = "bucket int, kind int, hash binary, ids binary, counts binary, pos binary"


def _spans(hashes: np.ndarray, texts: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, ...]:
    """Hash, text and position of every window of ``k`` words that lies in one text."""
    value = windows(hashes, k)
    begin = np.searchsorted(texts, np.arange(rows)).astype(np.int32)
    owner = texts[: len(value)].astype(np.int32)
    inside = owner == texts[k - 1 :] if len(value) else np.zeros(0, bool)
    at = np.flatnonzero(inside).astype(np.int32)
    return value[at], owner[at], at - begin[owner[at]]


def _packed(bucket, remainder, owner, pos, number, kind) -> list[tuple]:
    """Rows of one kind, one per bucket that occurs; inputs are sorted by bucket and owner."""
    if not len(bucket):
        return []
    new = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]))))
    counts = np.diff(np.append(new, len(bucket))).astype(np.uint32)
    ids, of = number[owner[new]], bucket[new]
    present = np.unique(bucket)
    low, high = np.searchsorted(bucket, present), np.searchsorted(bucket, present, side="right")
    first, last = np.searchsorted(of, present), np.searchsorted(of, present, side="right")
    rows = []
    for b, lo, hi, f, t in zip(present.tolist(), low, high, first, last, strict=True):
        place = pos[lo:hi]
        kept = place.astype(np.uint16 if place.max(initial=0) < 65536 else np.uint32)
        rows.append((b, kind, remainder[lo:hi].tobytes(), ids[f:t].tobytes(), counts[f:t].tobytes(), kept.tobytes()))
    return rows


def _anchors(block: int, buckets: int):
    def run(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1), 8 << 20):
                ids = batch.column(0).slice(low, high - low)
                real = ~np.array(ids.is_null())
                number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                _, _, hashes, texts = words(data, offsets)
                value, owner, pos = _spans(hashes, texts, high - low, block)
                use = real[owner]
                value, owner, pos = value[use], owner[use], pos[use]
                bucket = ((value >> U64(32)) % U64(buckets)).astype(np.int32)
                remainder = value.astype(np.uint32)
                del hashes, texts, value, use
                order = np.argsort(bucket, kind="stable")
                bucket, owner, pos, remainder = bucket[order], owner[order], pos[order], remainder[order]
                del order
                own = pos % block == 0
                rows = _packed(bucket, remainder, owner, pos, number, PROBE)
                rows += _packed(bucket[own], remainder[own], owner[own], pos[own], number, NOTICE)
                # The index needs the smallest document of each block once per piece.
                b, r, o = bucket[own], remainder[own], owner[own]
                order = np.lexsort((number[o], r, b))
                b, r, o = b[order], r[order], o[order]
                if len(b):
                    one = np.concatenate(([True], (b[1:] != b[:-1]) | (r[1:] != r[:-1])))
                    b, r, o = b[one], r[one], o[one]
                    order = np.lexsort((o, b))
                    b, r, o = b[order], r[order], o[order]
                    rows += _packed(b, r, o, np.zeros(len(b), np.int64), number, INDEX)
                del bucket, owner, pos, remainder, own, b, r, o
                if rows:
                    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    del rows
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "hash", "ids", "counts", "pos"])

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = np.frombuffer(row["hash"], np.uint32)
    docs = np.repeat(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.uint32))
    pos = np.frombuffer(row["pos"], np.uint16 if len(row["pos"]) == 2 * len(hashes) else np.uint32)
    return hashes, docs, pos.astype(np.int32)


def _grouped(docs: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row per document with its positions."""
    order = np.argsort(docs, kind="stable")
    docs, pos = docs[order], pos[order]
    new = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    ends = np.append(new, len(docs)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))
    return pa.RecordBatch.from_arrays([pa.array(docs[new]), lists], ["id", "pos"])


def _probed(batches):
    """Hits of the probes and notices to the blocks, from rows sorted by bucket and kind."""
    at, parts, key, least, most = None, [], None, None, None
    for batch in batches:
        for i in range(len(batch)):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(("bucket", "kind", "hash", "ids", "counts", "pos"))}
            if row["bucket"] != at:
                at, parts, key = row["bucket"], [], None
            hashes, docs, pos = _unpacked(row)
            if row["kind"] == INDEX:
                parts.append((hashes, docs))
                if len(parts) > 64:  # copies of a block fall together as they come
                    parts = [_least(parts)]
                continue
            if key is None:
                key, least = _least(parts) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                most, parts = least.copy(), []
            if not len(key):
                continue
            place = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
            known = key[place] == hashes
            place, docs, pos = place[known], docs[known], pos[known]
            if row["kind"] == PROBE:
                np.maximum.at(most, place, docs)
                hit = docs > least[place]
            else:
                hit = docs < most[place]
            if hit.any():
                yield _grouped(docs[hit], pos[hit])


def _least(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((docs, key))
    key, docs = key[order], docs[order]
    one = np.concatenate(([True], key[1:] != key[:-1]))
    return key[one], docs[one]


def _marks(column: pa.Array, row: int) -> np.ndarray:
    """The positions in a row's list of lists."""
    value = column[row]
    return np.unique(value.values.flatten().to_numpy()) if value.is_valid else np.zeros(0, np.int32)


def _extended(window: int, block: int):
    """Every window around a hit: ``(key, id, pos)``."""

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                _, _, hashes, texts = words(data, offsets)
                value, owner, pos = _spans(hashes, texts, high - low, window)
                begin = np.searchsorted(owner, np.arange(high - low + 1))
                near = np.zeros(len(value) + 1, np.int64)
                for i in range(high - low):
                    marks = _marks(batch.column(2), low + i)
                    size = begin[i + 1] - begin[i]
                    if size:  # a hit at p is held by the windows from p - (window - block) to p
                        first = np.clip(marks - (window - block), 0, size)
                        last = np.clip(marks + 1, 0, size)
                        np.add.at(near, begin[i] + first, 1)
                        np.add.at(near, begin[i] + last, -1)
                chosen = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                if len(chosen):
                    number = batch.column(0).slice(low, high - low).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(value[chosen].view(np.int64)),
                            pa.array(number[owner[chosen]]),
                            pa.array(pos[chosen].astype(np.int32)),
                        ],
                        ["key", "id", "pos"],
                    )

    return run


def _later(batches):
    """From rows sorted by key and id, those whose key has a smaller id."""
    key = lead = np.zeros(0, np.int64)
    for batch in batches:
        if not len(batch):
            continue
        k, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        first = i[start].copy()
        if len(key) and key[0] == k[0]:
            first[0] = lead[0]
        out = i > np.repeat(first, np.diff(np.append(start, len(k))))
        key, lead = k[-1:].copy(), first[-1:].copy()
        if out.any():
            yield _grouped(i[out], batch.column(2).to_numpy()[out])


def _kept(window: int):
    def run(batches):
        for batch in batches:
            found = ([], [], [])
            for i in range(len(batch)):
                text = batch.column(1)[i].as_py()
                parts = text.encode().split() if text else []
                marks = _marks(batch.column(2), i)
                total = len(parts)
                if len(marks):
                    cover = np.zeros(total + 1, np.int64)
                    np.add.at(cover, marks, 1)
                    np.add.at(cover, marks + window, -1)
                    parts = [parts[j] for j in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
                found[0].append(total)
                found[1].append(total - len(parts))
                found[2].append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string())],
                ["id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int = 13) -> DataFrame:
    """``(id, pos)``: per document the starts of its windows that a smaller id also has.

    ``window`` is odd. Words are runs of characters other than ASCII white space. Null or
    short texts have no windows; rows with a null id neither repeat nor are repeated; rows
    that share an id do not count as smaller than each other. Positions may repeat and
    come in several lists per document (array of arrays).
    """
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be an odd number of at least three words")
    ship()
    spark = docs.sparkSession
    block = (window + 1) // 2
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(size / 6 / BUCKET_WORDS))
    packed = docs.mapInArrow(_anchors(block, buckets), PACKED)
    probed = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    hits = written(probed.mapInArrow(_probed, "id bigint, pos array<int>"))
    release(spark)
    near = docs.join(hits.groupBy("id").agg(F.collect_list("pos").alias("pos")), "id").select("id", "text", "pos")
    windows_ = near.mapInArrow(_extended(window, block), "key bigint, id bigint, pos int")
    later = windows_.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_later, "id bigint, pos array<int>")
    found = written(later)
    release(spark)
    return found.groupBy("id").agg(F.collect_list("pos").alias("pos"))


def dedup_substrings(docs: DataFrame, id_col: str, text_col: str, window: int = 13) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` per row of ``docs``; other columns are not read.

    Removed is every word that a repeated window covers, all windows judged on the input.
    A null or empty text has no words and the hash of the empty string. An empty table
    gives an empty one. See :func:`repeats`.
    """
    marks = repeats(docs, id_col, text_col, window)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    joined = own.join(marks, "id", "left").select("id", "text", "pos")
    return joined.mapInArrow(_kept(window), "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents by windows of 13 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE = {"op5_substring_dedup": sql.REPEATS}
