"""Ratio-guided chunking (C5-C10), for counters whose counts do not add up.

Each chunk's end depends on where the one before ended and on token counts of
arbitrary slices, so one document is a sequential walk. Spark finds the sentence
boundaries and counts the documents that fit; the walk of the others runs per
document in Arrow batches and any number of documents runs side by side. A batch is
worked off in slices, so a Python worker holds a batch as it came and little more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.columns import let
from textmill.functions.sentences import sentence_lengths
from textmill.functions.text import strip
from textmill.functions.tokens import DEFAULT_COUNTER, Meter
from textmill.operators.chunk_pack import in_blocks

SHRINK, ATTEMPTS = 0.9, 20  # Fixed values: how an over-long guess is reduced.
FLUSH = 4096  # Chunks handed back to Spark at a time.
SLICE = 1 << 22  # Bytes of text taken from a batch, and of chunks handed back, at a time; a longer document is one slice.
OVERLAP_WINDOW = 500  # Fixed value: characters the overlap ratio is taken from.


def _guesses(first: int) -> Iterator[int]:
    """Window sizes to try, each a tenth shorter than the one before."""
    size = first
    for _ in range(ATTEMPTS + 1):
        yield size
        size = max(1, int(size * SHRINK))


def _window_end(text: str, bounds: np.ndarray, start: int, size: int) -> int:
    """End of a window of about ``size``: a sentence end, else a space, else beyond the word."""
    target = start + size
    at = int(np.searchsorted(bounds, target, side="right")) - 1
    if at >= 0 and bounds[at] > start:
        return int(bounds[at])
    if target >= len(text):
        return len(text)
    end = text.rfind(" ", start + 1, target + 1)
    if end < 0:
        end = text.find(" ", target)
        end = len(text) if end < 0 else end
    return end if end > start else min(start + max(1, size), len(text))


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """The slice without whitespace at its ends."""
    part = text[start:stop]
    start += len(part) - len(part.lstrip())
    return start, max(start, stop - (len(part) - len(part.rstrip())))


def _word_prefix(text: str, limit: int, meter: Callable[[str], Meter]) -> tuple[str, int]:
    """Longest run of leading words within ``limit`` tokens, at least one word."""

    def tokens(parts: list[str], n: int) -> int:
        prefix = " ".join(parts[:n])
        return meter(prefix)(0, len(prefix))

    # Look only as far ahead as the words may fit.
    reach = limit
    while True:
        parts = text.split(None, reach)[:reach]
        if len(parts) < reach or tokens(parts, reach) > limit:
            break
        reach *= 2
    fitting = bisect_right(range(1, len(parts) + 1), limit, key=lambda n: tokens(parts, n))
    n = max(1, fitting)
    return " ".join(parts[:n]), tokens(parts, n)


def walk(
    text: str, bounds: np.ndarray, limit: int, overlap: int, meter: Callable[[str], Meter]
) -> Iterator[tuple[str, int]]:
    """Chunks of one text that does not fit into ``limit`` tokens."""
    tokens = meter(text)
    start, size = 0, len(text)
    while start < size:
        left = tokens(start, size)
        if left <= limit:
            yield text[start:].strip(), left
            return
        first = min(int(limit * ((size - start) / max(left, 1))), size - start)
        for guess in _guesses(first):
            end = _window_end(text, bounds, start, guess)
            low, high = _trimmed(text, start, end)
            chunk, seen = text[low:high], tokens(low, high)
            if seen <= limit:
                break
        else:
            chunk, seen = _word_prefix(text[start:], limit, meter)
            end = start + len(chunk)
            while end < size and text[end] == " ":
                end += 1
        if chunk:
            yield chunk, seen
        back = 0
        if overlap and end < size:
            tail = max(0, end - OVERLAP_WINDOW)
            nearby = tokens(tail, end) if tail < end else 0
            back = int(overlap * ((end - tail) / nearby)) if nearby else 0
        start = max(end - back, start + 1)


def chunk_exact(
    docs: DataFrame, max_tokens: int, overlap: int, counter=DEFAULT_COUNTER, *keep: str, failures: bool = False
) -> DataFrame:
    """``(source_file, *keep, chunk_index, text, token_count)`` of ``docs(source_file, text)``.

    Documents that fit are one chunk by an expression and only pass through Python; the others
    come with their sentence lengths and are walked. With ``failures`` a document whose walk
    fails is one row without text that says why in ``failure``; otherwise it ends the job.
    """
    columns = ["source_file", *keep]
    counted = docs.select(*columns, strip("text").alias("text")).withColumn("token_count", counter.count("text").cast("int"))
    over = F.col("token_count") > max_tokens
    # One pass for both kinds: a union of two branches would read and count every document twice.
    prepared = counted.where(F.col("text") != "").withColumn("lengths", F.when(over, sentence_lengths("text")))
    produced = [("chunk_index", T.IntegerType()), ("text", T.StringType()), ("token_count", T.IntegerType())]
    if failures:
        produced.append(("failure", T.StringType()))
    schema = T.StructType([counted.schema[c] for c in columns] + [T.StructField(n, t) for n, t in produced])
    return prepared.mapInArrow(_walked(columns, max_tokens, overlap, counter.meter(), failures), schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``SLICE`` bytes of text, without copying it."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)


def _walked(
    columns: list[str], max_tokens: int, overlap: int, make_meter: Callable[[], Callable[[str], Meter]], failures: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ``(*columns, text, token_count, lengths)`` to batches of chunks; see :func:`chunk_exact`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = make_meter()
        for batch in batches:
            string = batch.schema.field("text").type
            fields = [*(batch.schema.field(c) for c in columns), pa.field("chunk_index", pa.int32()), pa.field("text", string)]
            fields += [pa.field("token_count", pa.int32()), *([pa.field("failure", string)] if failures else [])]
            schema = pa.schema(fields)

            def handed(rows: pa.RecordBatch, *made: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *made], schema=schema)

            for part in _slices(batch):
                fits = pc.less_equal(part.column("token_count"), max_tokens)
                whole, long = part.filter(fits), part.filter(pc.invert(fits))
                if n := whole.num_rows:
                    none = [pa.nulls(n, string)] if failures else []
                    yield handed(whole, pa.array(np.zeros(n, np.int32)), whole.column("text"), whole.column("token_count"), *none)

                def flushed(found: list[tuple]) -> pa.RecordBatch:
                    at, *made = zip(*found)
                    return handed(long.select(columns).take(pa.array(at)), *map(pa.array, made, schema.types[len(columns) :]))

                found: list[tuple] = []
                held = 0
                for at in range(long.num_rows):
                    try:
                        text = long.column("text")[at].as_py()
                        bounds = np.cumsum(long.column("lengths")[at].values.to_numpy(), dtype=np.int64)
                        none = (None,) if failures else ()
                        chunks = [(at, i, *chunk, *none) for i, chunk in enumerate(walk(text, bounds, max_tokens, overlap, meter))]
                    except Exception as exc:
                        if not failures:
                            raise
                        chunks = [(at, 0, None, 0, f"{type(exc).__name__}: {exc}")]
                    found += chunks
                    held += sum(len(c[2] or "") for c in chunks)
                    if len(found) > FLUSH or held > SLICE:
                        yield flushed(found)
                        found, held = [], 0
                if found:
                    yield flushed(found)

    return run


def sentence_ends(docs: DataFrame, key: str = "source_file", text: str = "text") -> DataFrame:
    """``(key, bound)``: the end offset of every sentence."""
    return docs.select(key, F.explode(running_ends(sentence_lengths(text))).alias("bound"))


def running_ends(lengths: Column) -> Column:
    """Running sums of an array, in blocks, so that no growing array is long."""
    none, zero = F.array().cast("array<int>"), F.lit(0)

    def run(values: Column) -> Column:
        grow = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"] + x).alias("all"))
        return F.aggregate(values, F.struct(zero.alias("sum"), none.alias("all")), grow, lambda s: s["all"])

    def whole(blocks: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<int>").alias("all"))
        add = lambda s, b: F.struct(
            (s["sum"] + F.aggregate(b, zero, lambda a, x: a + x)).alias("sum"), F.array_append(s["all"], s["sum"]).alias("all")
        )
        before = F.aggregate(blocks, start, add, lambda s: s["all"])
        return F.flatten(F.zip_with(blocks, before, lambda b, n: F.transform(run(b), lambda x: x + n)))

    return let(in_blocks(lengths), whole)


def snap_targets(bounds: DataFrame, targets: DataFrame, key: str = "source_file") -> DataFrame:
    """Last boundary at or before each target (C5), null where there is none.

    An as-of lookup: both sides are merged in position order and the latest
    boundary is carried forward, so no pair of boundary and target is formed.
    ``bounds(key, bound)``, ``targets(key, start, target)``; a boundary counts
    only behind the target's ``start``.
    """
    empty = F.lit(None).cast("int")
    merged = bounds.select(
        key, F.col("bound").cast("int").alias("_pos"), F.lit(0).alias("_side"), F.col("bound").cast("int").alias("bound"), empty.alias("start")
    ).unionByName(
        targets.select(
            key, F.col("target").cast("int").alias("_pos"), F.lit(1).alias("_side"), empty.alias("bound"), F.col("start").cast("int").alias("start")
        )
    )
    latest = Window.partitionBy(key).orderBy("_pos", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        merged.withColumn("_last", F.last("bound", ignorenulls=True).over(latest))
        .where(F.col("_side") == 1)
        .select(key, "start", F.col("_pos").alias("target"), F.when(F.col("_last") > F.col("start"), F.col("_last")).alias("snapped"))
    )
