"""Words of Arrow text columns as byte spans with 64-bit hashes, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. These are ASCII, so the runs are the same on UTF-8 bytes as on
characters. All steps are array operations over a piece of a batch; a piece holds
whole texts of a few megabytes, or one longer text, whose words are hashed slice by
slice so that memory stays near the size of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
U64 = np.uint64
SPACES = (9, 10, 11, 12, 13, 32)
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    with np.errstate(over="ignore"):
        value = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    return space, lower, value


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, tuple] = {}


def _constants(n: int) -> tuple[np.ndarray, ...]:
    if "tables" not in _CACHE:
        _CACHE["tables"] = _tables()
    if "powers" not in _CACHE or len(_CACHE["powers"][0]) < n:
        _CACHE["powers"] = (_powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n))
    return (*_CACHE["tables"], *_CACHE["powers"])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of the texts in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, row after the last, bytes, offsets."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space, _, value, power, inverse = _constants(len(data) + 1)
    inside = ~space[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(value[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return starts, ends, hashes


def _long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one long text, hashed in slices that end behind a space."""
    space, *_ = _constants(1)
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + PIECE_BYTES)
        while to < len(data) and not space[data[to - 1]]:
            ahead = np.flatnonzero(space[data[to : to + PIECE_BYTES]])
            to = to + int(ahead[0]) + 1 if len(ahead) else min(len(data), to + PIECE_BYTES)
        part = _slice(data[at:to], np.array([0, to - at]))
        found.append((part[0] + at, part[1] + at, part[2]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, ...]:
    """Start, end, hash and text number of every word of a piece.

    Texts are hashed about ``PIECE_BYTES`` at a time, whatever the size of the piece.
    """
    _, low, *_ = _constants(1)
    found, first, texts = [], 0, len(offsets) - 1
    while first < texts or not found:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1)
        last = min(last, texts)
        begin, end = int(offsets[first]), int(offsets[last])
        part = low[data[begin:end]] if lower else data[begin:end]
        if len(part) > 2 * PIECE_BYTES:
            starts, ends, hashes = _long(part)
        else:
            starts, ends, hashes = _slice(part, offsets[first : last + 1] - begin)
        found.append((starts + begin, ends + begin, hashes))
        first = last
        if first >= texts:
            break
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    return starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; one for every position that has ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j in range(k):
        total += hashes[j : j + n] * U64(pow(BASE, 2 * j + 1, 1 << 64))
    return mix(total + U64(k))


def shingles(hashes: np.ndarray, texts: np.ndarray, count: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each text's distinct ``k``-word shingles, in order.

    A text with fewer words has its whole sequence as its one shingle; one without
    words has none.
    """
    sizes = np.bincount(texts, minlength=count)
    whole = windows(hashes, k)
    same = texts[: len(whole)] == texts[k - 1 :] if len(whole) else np.zeros(0, bool)
    owner, value = [texts[: len(whole)][same]], [whole[same]]
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for size in range(1, k):
        short = np.flatnonzero(sizes == size)
        if len(short):
            rows = hashes[begin[short][:, None] + np.arange(size)]
            factors = np.array([pow(BASE, 2 * j + 1, 1 << 64) for j in range(size)], U64)
            owner.append(short)
            value.append(mix((rows * factors).sum(axis=1, dtype=U64) + U64(size)))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owner, value = owner[new], value[new]
    return owner, value
