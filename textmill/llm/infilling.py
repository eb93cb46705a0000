"""Fill-in-the-middle by content-defined chunks.

Cuts are given in code points, texts come as bytes. A rolling hash over the last 32 bytes
ends a chunk wherever its high bits are zero, so that a passage which many texts share is
cut into the same chunks in all of them. What a chunk contributes is worked out once and
kept by its content: the number of code points that begin in it, whether it holds a
marker, and the bytes at its two borders, with which markers lying across chunks are seen.
A text is counted by adding up its chunks; a cut is found by the chunk in which the sum
reaches it, and inside that chunk by its bytes.

The cache is keyed by the whole bytes of a chunk, so that equal hashes of different chunks
do no harm, and is emptied when it holds ``CACHE_BYTES``. Which parts a document has hangs
on its id alone: rows do not depend on each other, a rerun gives the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import sql
from textmill.llm.shared import ship
from textmill.llm.words import mix, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
BORDER = max(map(len, MARKERS)) - 1
CUT_BITS = 9
LEAST, MOST = 128, 4096
CACHE_BYTES = 32 << 20
FIM = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes that end at each byte; a byte's share leaves by being shifted out."""
    value = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[data]
    for step in (1, 2, 4, 8, 16):
        after = value.copy()
        after[step:] += value[:-step] << np.uint32(step)
        value = after
    return value


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text, from ``LEAST`` to ``MOST`` bytes, the last one shorter."""
    marks = np.flatnonzero(rolling(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out = []
    first = np.searchsorted(marks, offsets[:-1] + LEAST)
    last = np.searchsorted(marks, offsets[1:])
    for start, stop, lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first, last, strict=True):
        ends, at = [], start
        for mark in marks[lo:hi].tolist():
            while mark - at > MOST:
                at += MOST
                ends.append(at)
            if mark - at >= LEAST:
                at = mark
                ends.append(at)
        while stop - at > MOST:
            at += MOST
            ends.append(at)
        if stop > at:
            ends.append(stop)
        out.append(ends)
    return out


def _begins(part: bytes) -> np.ndarray:
    """Where code points begin: all bytes but those that continue one."""
    return np.flatnonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80)


class Chunks:
    """Summaries of chunks, by content."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, bool]] = {}
        self.size = 0

    def summary(self, part: bytes) -> tuple[int, bool]:
        """Code points that begin in the chunk, and whether it holds a marker."""
        found = self.known.get(part)
        if found is None:
            found = len(_begins(part)), any(m in part for m in MARKERS)
            if self.size > CACHE_BYTES:
                self.known, self.size = {}, 0
            self.known[part] = found
            self.size += len(part) + 128
        return found

    def measured(self, data: bytes, start: int, ends: list[int]) -> tuple[list[int], bool]:
        """Code points before the end of each chunk, and whether a marker lies anywhere in the text."""
        sums, total, marked, border = [], 0, False, b""
        for end in ends:
            part = data[start:end]
            count, holds = self.summary(part)
            total += count
            sums.append(total)
            if not marked:
                marked = holds or any(m in border + part[:BORDER] for m in MARKERS)
                border = (border + part)[-BORDER:] if len(part) < BORDER else part[-BORDER:]
            start = end
        return sums, marked


def _located(data: bytes, start: int, ends: list[int], sums: list[int], cut: int) -> int:
    """The byte before which ``cut`` code points of the text lie."""
    chunk = int(np.searchsorted(sums, cut, side="right"))
    if chunk == len(ends):
        return ends[-1] if ends else start
    low = ends[chunk - 1] if chunk else start
    return low + int(_begins(data[low : ends[chunk]])[cut - (sums[chunk - 1] if chunk else 0)])


def _transformed(plain_from: int, spm_below: int, seed: int):
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        chunks = Chunks()
        number = ids.to_pylist()
        sizes, forms, heads, middles, outputs = [], [], [], [], []
        for low, high, array, offsets in pieces(texts):
            data = array.tobytes()
            bounds = offsets.tolist()
            for i, ends in enumerate(chunk_ends(array, offsets), low):
                start, stop = bounds[i - low], bounds[i - low + 1]
                sums, marked = chunks.measured(data, start, ends)
                n = sums[-1] if sums else 0
                name = "" if number[i] is None else str(number[i])
                h = hashlib.sha256(f"{seed}:{name}".encode()).digest()
                h1, h2, h3, h4 = (int.from_bytes(h[j : j + 4], "big") for j in (0, 4, 8, 12))
                sizes.append(n)
                if not n or marked or h3 % 100 >= plain_from:
                    forms.append("plain")
                    heads.append(None)
                    middles.append(None)
                    outputs.append(data[start:stop])
                    continue
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                x, y = (_located(data, start, ends, sums, c) for c in (a, b))
                prefix, middle, suffix = data[start:x], data[x:y], data[y:stop]
                p, s, m = MARKERS
                spm = h4 % 100 < spm_below
                forms.append("spm" if spm else "psm")
                heads.append(a)
                middles.append(b - a)
                order = (s, suffix, p, prefix) if spm else (p, prefix, s, suffix)
                outputs.append(b"".join((*order, m, middle)))
        return pa.StructArray.from_arrays(
            [
                pa.array(sizes, pa.int64()),
                pa.array(forms, pa.string()),
                pa.array(heads, pa.int64()),
                pa.array(middles, pa.int64()),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return run


def infilled(number: Column, text: Column, rate: int = 90, spm_rate: int = 20, seed: int = 1) -> Column:
    """``struct<n, form, prefix_chars, middle_chars, output>`` of a text.

    ``n`` counts code points. Of a hundred texts about ``rate`` are cut in three, of these
    about ``spm_rate`` with the suffix first (``spm``), the others with the prefix first
    (``psm``); a text that is null, empty or holds a marker stays as it is (``plain``, output
    the text, empty for null). The draws come from the seed and ``number`` (an integer; a
    null counts as an empty name, so rows without one are drawn alike).
    """
    ship()
    run = _transformed(rate, spm_rate, seed)

    @F.arrow_udf(FIM)
    def transform(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return run(ids, texts)

    return transform(number.cast("bigint"), text)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: its parts, found by the markers, in their order.

    A text that is cut holds no marker, so the first of each kind is the one that was put in.
    """

    def between(s: Column, begin: Column, end: Column) -> Column:
        return F.substring(s, begin, end - begin)

    width = len(PREFIX)
    first, second = F.locate(PREFIX, output), F.locate(SUFFIX, output)
    mark, end = F.locate(MIDDLE, output), F.length(output) + 1
    middle = between(output, mark + width, end)
    psm = F.concat(between(output, first + width, second), middle, between(output, second + width, mark))
    spm = F.concat(between(output, first + width, mark), middle, between(output, second + width, first))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, id_col: str, text_col: str, rate: int = 90, spm_rate: int = 20, seed: int = 1, name: str = "fim"
) -> DataFrame:
    """``docs`` with :func:`infilled` of its text as a column; a column of that name is replaced.

    Other columns pass through, repeated rows are cut alike, an empty table gives an empty one.
    """
    return docs.withColumn(name, infilled(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), rate, spm_rate, seed))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents, nine tenths of them cut, a fifth of these with the suffix first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs, "doc_id", "text")
    return done.select(
        "doc_id",
        *[F.col(f"fim.{c}") for c in ("n", "form", "prefix_chars", "middle_chars")],
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE = {"op13_fill_in_middle": sql.INFILL}
