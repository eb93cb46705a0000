"""Ranked lexical search by an automaton over the documents' own text.

The terms of all items, each between two guards, form one Aho-Corasick automaton, which
tasks build from a broadcast list. A document, its separators turned into guards, passes
through it once: every output is one occurrence of a whole term, so that the counts come
straight from the text and no index of documents is made. Terms longer than ``LONG`` code
points are not walked letter by letter but looked up by their SHA-256. What is written is a
row per document with its length and the counts of the items' terms in it; from this come
the numbers of documents and, per term, of documents holding it.

The outputs map to items by lists of the items that hold a term. A task adds up the scores
of a block of documents for all items, and keeps the best ``k`` of each; a window picks the
best of all tasks. Scores are whole numbers throughout.

Sizes: an automaton holds at most ``VOCABULARY_BYTES`` of terms, a broadcast of items at
most ``PAIRS`` pairs of item and term. Beyond that there are several automata, whose counts
are joined per document, and several broadcasts. An item with over an eighth of ``PAIRS``
terms is scored by a join and a grouping instead.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import sql
from textmill.llm.shared import ship, written
from textmill.llm.words import pieces

#: A term is a longest run of digits, ASCII letters and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GUARD = " "
LONG = 64
VOCABULARY_BYTES = 4 << 20
PAIRS = 1 << 21
BLOCK_CELLS = 1 << 20
COUNTS = "doc bigint, text_hash bigint, n bigint, ids array<bigint>, tfs array<int>"


def terms_of(text: Column) -> Column:
    """The terms of a text, only A-Z lower-cased, with repeats."""
    upper = "".join(map(chr, range(65, 91)))
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(TERM), F.lit(0))


def _folded() -> np.ndarray:
    """Bytes to bytes: separators become the guard, A-Z small letters."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    word = (table >= 128) | ((table >= 48) & (table <= 57)) | ((table >= 97) & (table <= 122))
    table[~word] = ord(GUARD)
    return table


class _Counter:
    """Counts the terms of one automaton in texts."""

    def __init__(self, vocabulary: pa.Table) -> None:
        import ahocorasick

        self.table = _folded()
        self.walk = ahocorasick.Automaton()
        self.long: dict[str, int] = {}
        for row in vocabulary.to_pylist():
            if row["term"] is None:
                self.long[row["digest"]] = row["id"]
            else:
                self.walk.add_word(f"{GUARD}{row['term']}{GUARD}", row["id"])
        if len(self.walk):
            self.walk.make_automaton()

    def count(self, data: np.ndarray, offsets: np.ndarray):
        """``(number of terms, {term number: times})`` of each text of a piece."""
        data = self.table[data]
        inside = data != ord(GUARD)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[first], end[last] = inside[first], inside[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sizes = np.diff(np.searchsorted(starts, offsets))
        # Bytes are never fewer than code points: what is short in bytes needs no second look.
        long = np.flatnonzero(ends - starts > LONG) if self.long else []
        owner = np.searchsorted(offsets, starts[long], side="right") - 1 if len(long) else []
        seen: dict[int, Counter] = {}
        for at, text in zip(long, owner, strict=True):
            number = self.long.get(hashlib.sha256(data[starts[at] : ends[at]].tobytes()).hexdigest())
            if number is not None:
                seen.setdefault(int(text), Counter())[number] += 1
        value = itemgetter(1)
        for i, size in enumerate(sizes.tolist()):
            found = seen.get(i, Counter())
            if size and len(self.walk):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                found.update(map(value, self.walk.iter(f"{GUARD}{text}{GUARD}")))
            yield size, found


def _counted(shared: Broadcast):
    """A row per document that has a term: its id, its number of terms, and the counts of the items' terms."""

    def run(batches):
        counter = _Counter(shared.value)
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                found = [(i, n, c) for i, (n, c) in enumerate(counter.count(data, offsets), low) if n]
                if not found:
                    continue
                rows = pa.array([i for i, _, _ in found], pa.int64())
                ends = np.cumsum([0, *(len(c) for _, _, c in found)]).astype(np.int32)
                total = int(ends[-1])
                ids = np.fromiter((t for _, _, c in found for t in c), np.int64, total)
                tfs = np.fromiter((v for _, _, c in found for v in c.values()), np.int32, total)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(2).take(rows),
                        pa.array([n for _, n, _ in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tfs)),
                    ],
                    ["doc", "text_hash", "n", "ids", "tfs"],
                )

    return run


def _dealt(rows: DataFrame, key: str, size: Column, bound: int) -> tuple[DataFrame, int]:
    """``rows`` with a ``part`` of their key so that the sizes of a part sum to at most ``bound``; the number of parts.

    The rows of a key must sum to less than the bound.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, math.ceil(2 * total / bound)) if total > bound else 1
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        largest = dealt.groupBy("part").agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0
        if largest <= bound:
            return dealt, parts
        parts *= 2


def term_counts(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc, n, ids, tfs)`` per document with a term, and ``(term, id)`` of the column ``term`` of ``terms``.

    ``terms`` holds distinct terms. ``n`` counts all terms of a document, ``ids`` and
    ``tfs`` those of ``terms`` that it holds and how often.
    """
    ship()
    spark = docs.sparkSession
    long = F.length("term") > LONG  # such a term travels as its digest
    size = F.when(long, 64).otherwise(F.octet_length("term")) + 16
    dealt, parts = _dealt(terms.select("term"), "term", size, VOCABULARY_BYTES)
    order = Window.partitionBy("part").orderBy("term")  # a part is no larger than an automaton
    number = F.col("part").cast("bigint") * (1 << 32) + F.row_number().over(order)
    vocabulary = written(dealt.withColumn("id", number))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    every = None
    for part in range(parts):
        listed = vocabulary.where(F.col("part") == part).select(
            F.when(~long, F.col("term")).alias("term"), F.when(long, F.sha2("term", 256)).alias("digest"), "id"
        )
        shared = spark.sparkContext.broadcast(listed.toArrow())
        counts = written(own.mapInArrow(_counted(shared), COUNTS))
        shared.destroy()
        every = counts if every is None else every.union(counts.withColumn("part", F.lit(part)))
        if part == 0 and parts > 1:
            every = every.withColumn("part", F.lit(0))
    if parts == 1:
        return every.drop("text_hash"), vocabulary.select("term", "id")
    # A row is found again by its id and text; rows alike in both are so in every part.
    per_part = every.groupBy("doc", "text_hash", "n", "part").agg(
        F.count("*").cast("int").alias("times"), F.first("ids").alias("ids"), F.first("tfs").alias("tfs")
    )
    parts_of = F.sort_array(F.collect_list(F.struct("part", "ids", "tfs", "times")))
    joined = per_part.groupBy("doc", "text_hash", "n").agg(parts_of.alias("parts"))
    again = joined.select(
        "doc",
        "n",
        F.flatten("parts.ids").alias("ids"),
        F.flatten("parts.tfs").alias("tfs"),
        F.explode(F.array_repeat(F.lit(0), F.col("parts")[0]["times"])),
    )
    return written(again.select("doc", "n", "ids", "tfs")), vocabulary.select("term", "id")


def _length_norm(n, docs: int, length: int):
    """100 for a document of average length, from 50 up; for numbers, arrays and columns."""
    if isinstance(n, Column):
        return F.lit(50) + F.expr(f"(50L * n * {docs}L) div {length}L")
    return 50 + (50 * n * docs) // length


class _Best:
    """The ``k`` best ``(score, doc)`` of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 3
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.new.append((item, score, doc))
        self.waiting += len(item)
        if self.waiting > max(BLOCK_CELLS, 2 * len(self.kept[0])):
            self.prune()

    def prune(self) -> None:
        item, score, doc = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        begin = np.searchsorted(item, item)
        place = np.arange(len(item)) - begin
        full = place == self.k - 1
        self.floor[item[full]] = score[full]
        use = place < self.k
        self.kept = [item[use], score[use], doc[use]]
        self.new, self.waiting = [], 0


def _scored(shared: Broadcast, docs: int, length: int, k: int):
    """The ``k`` best documents of the task for each item of the broadcast."""

    def run(batches):
        items, term, weight, begin, holders = shared.value
        best = _Best(len(items), k)
        block = max(1, BLOCK_CELLS // max(1, len(items)))
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            for low in range(0, len(batch), block):
                part = batch.slice(low, block)
                doc, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                ids = part.column(2).flatten().to_numpy()
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(part)), part.column(2).value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(term, ids), len(term) - 1)
                known = term[at] == ids
                at, tf, row = at[known], tf[known], row[known]
                gain = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * _length_norm(n, docs, length)[row]))
                score = np.zeros(len(part) * len(items), np.int64)
                count = begin[at + 1] - begin[at]
                ends = np.cumsum(count)
                first = 0
                while first < len(at):  # outputs to items, a bounded number at a time
                    last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_CELLS)))
                    some = slice(first, last)
                    c = count[some]
                    within = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                    item = holders[np.repeat(begin[at[some]], c) + within]
                    np.add.at(score, np.repeat(row[some], c) * len(items) + item, np.repeat(gain[some], c))
                    first = last
                cells = score.reshape(len(part), len(items))
                r, item = np.nonzero(cells >= best.floor)
                best.add(item, cells[r, item], doc[r])
        best.prune()
        item, score, doc = best.kept
        yield pa.RecordBatch.from_arrays(
            [items.take(pa.array(item)), pa.array(doc), pa.array(score)], ["item_id", "doc_id", "score"]
        )

    return run


def _maps(pairs: pa.Table) -> tuple:
    """Items, and per term its weight and the items that hold it."""
    pairs = pairs.combine_chunks()
    coded = pc.dictionary_encode(pairs.column("item"), null_encoding="encode").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    ids, weight = pairs.column("id").to_numpy(), pairs.column("w").to_numpy()
    order = np.argsort(ids, kind="stable")
    term, first = np.unique(ids[order], return_index=True)
    begin = np.append(first, len(ids)).astype(np.int64)
    return coded.dictionary, term, weight[order][first], begin, coded.indices.to_numpy()[order].astype(np.int64)


def ranked_documents(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, k: int = 50
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of each item with the highest scores above 0.

    Terms are as in :func:`terms_of`. A term's weight is ``floor(1000 * ln((2N + 2) / (2df + 1)))``
    of ``N`` documents with terms, ``df`` of them holding it; a document's score adds up
    ``w * (10**9 * tf div (1000 * tf + 20 * m))`` over the item's distinct terms, with
    ``m = 50 + 50 * n * N div L`` by its own and all documents' numbers of terms. Equal
    scores go by ascending id.

    Documents that are null or have no term take no part; one with a null id counts in the
    statistics but is not returned. Rows that repeat an id are documents of their own. Rows
    that repeat an item's id, null included, are one item with the terms of all of them.
    Other columns are not read. Empty tables on either side give an empty one.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(item_text_col))).alias("term"))
    asked = written(asked.distinct())
    counts, vocabulary = term_counts(docs, id_col, text_col, asked.select("term").distinct())
    totals = counts.agg(F.count("*"), F.sum("n")).first()
    number, length = totals[0], totals[1]
    kind = asked.schema["item"].dataType.simpleString()
    schema = f"item_id {kind}, doc_id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    if number:
        frequency = counts.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * number + 2) / (2.0 * F.col("df") + 1)))
        weighed = vocabulary.join(frequency, "id").select("term", "id", weight.alias("w")).where("w > 0")
        pairs = written(asked.join(weighed, "term").select("item", "id", "w"))
        sizes = pairs.groupBy("item").agg(F.count("*").alias("terms"))
        dealt, parts = _dealt(sizes.where(F.col("terms") <= PAIRS // 8), "item", F.col("terms"), PAIRS)
        dealt = written(dealt)
        for part in range(parts):
            chosen = dealt.where(F.col("part") == part).select(F.col("item").alias("own"))
            some = pairs.join(chosen, F.col("item").eqNullSafe(F.col("own")), "left_semi").toArrow()
            if not len(some):
                continue
            shared = spark.sparkContext.broadcast(_maps(some))
            best = counts.select("doc", "n", "ids", "tfs").mapInArrow(_scored(shared, number, length, k), schema)
            found = found.union(written(best))
            shared.destroy()
        long = sizes.where(F.col("terms") > PAIRS // 8).select(F.col("item").alias("own"))
        if long.head(1):
            wide = pairs.join(long, F.col("item").eqNullSafe(F.col("own")), "left_semi")
            found = found.union(_grouped(counts, wide, number, length))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score"
    )


def _grouped(counts: DataFrame, pairs: DataFrame, docs: int, length: int) -> DataFrame:
    """All scores above 0 of items too long for a broadcast."""
    rows = counts.where("doc is not null").withColumn("m", _length_norm(F.col("n"), docs, length))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "doc", "m", F.explode(F.arrays_zip("ids", "tfs")).alias("t"))
    each = each.select("row", "doc", F.col("t.ids").alias("id"), F.expr("(1000000000L * t.tfs) div (1000L * t.tfs + 20L * m)").alias("gain"))
    scores = each.join(pairs, "id").groupBy("item", "row", "doc").agg(F.sum(F.col("w") * F.col("gain")).alias("score"))
    return scores.where("score > 0").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "score")


def op12_lexical_scan(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_documents(docs, "doc_id", "text", items, "item_id", "text")


QUERIES = {"op12_lexical_scan": op12_lexical_scan}
ORACLE = {"op12_lexical_scan": sql.RANKED}
