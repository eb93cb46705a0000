"""N-gram Jaccard join by parity sketches.

Every text is the set of its distinct k-word shingles. Two sets at Jaccard similarity
t or more differ in at most ``(1 - t) / (1 + t)`` of the sum of their sizes. A parity
sketch XORs one bit per shingle, so the Hamming distance of two sketches is at most the
size of the symmetric difference: a lower bound that discards pairs without reading them.

The join itself is a pigeonhole argument on such sketches. Sizes fall into bands, a band
ending where the next could no longer reach the threshold, so partners lie in the same
band or the next. In the scheme of a band, whose pairs differ in at most D shingles, the
shingles are dealt by hash into m > D parts, and the parity sketch of a part (wide: the
XOR of 64-bit hashes) is its join key. D differences leave m - D parts equal. Empty
parts say little and would meet in large groups; m is chosen so that texts with up to
``m - D - 1`` empty parts can leave them out and still share another part. Texts with more
of them keep all.

Texts of common phrases share a few keys by chance, ever more of them in a larger corpus,
while partners share many. From its size, its empty parts and the differences a partner may
have follows the number of keys a text shares with any partner under a scheme. All of these
but one it can do without, and of its keys that others have it leaves out so many, those of
most texts first: of the keys two partners share the one of the fewest texts stays with both.

Equal sets are one class and travel as one. Classes that hold over a thousandth of the
rows, of which there are under a thousand, send keys for their smallest id alone. Groups
of a key are never expanded: first each member is paired with one member of its group and
the pairs verified; only where a group of three or more then still spans several components,
pairs across components are formed, filtered by sketch distance and verified. Every link
between two texts joins their components, whichever pairs were skipped. Only the texts of
pairs that the sketches let through are read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm import sql
from textmill.llm.shared import components, release, ship, written
from textmill.llm.words import U64, mix, pieces, shingles, words

SKETCH_WORDS = 16
HEAVY = 1000
MANY = 4096
_BANDS: dict[tuple[int, int], tuple] = {}


def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Last size, differences D, parts m and empty parts allowed of each band."""
    if (num, den) in _BANDS:
        return _BANDS[num, den]
    last, most, parts, weak = [], [], [], []
    size, low = 0, 1
    while size < 1 << 32:
        low, size = size + 1, max(size + 1, size * den // num)
        d = size * (den - num) // num
        m, w = d + 1, 0
        for extra in range(1, min(m, 4000)):
            rate = low / (d + 1 + extra)
            expected = (d + 1 + extra) * math.exp(-rate)
            if expected + 4 * math.sqrt(expected) <= extra:
                m, w = d + 1 + extra, extra
                break
        last.append(size), most.append(d), parts.append(m), weak.append(w)
    _BANDS[num, den] = tuple(np.array(x, np.int64) for x in (last, most, parts, weak))
    return _BANDS[num, den]


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, row after the last, owner and shingle of every set element, sizes."""
    for low, high, data, offsets in pieces(batch.column(1)):
        _, _, hashes, texts = words(data, offsets, lower=True)
        owner, value = shingles(hashes, texts, high - low, k)
        yield low, high, owner, value, np.bincount(owner, minlength=high - low)


def _spare(owner, value, sizes, num, den) -> np.ndarray:
    """Number of shared keys each text can do without, under its scheme of even number and of odd."""
    last, _, parts, weak = bands(num, den)
    band = np.searchsorted(last, sizes)
    spread = mix(value + U64(3))
    out = np.zeros((2, len(sizes)), np.int32)
    for lower in (0, 1):
        scheme = np.maximum(band - lower, 0)
        m = parts[scheme]
        begin = np.cumsum(m) - m
        empty = np.ones(int(m.sum()), np.int64)
        empty[begin[owner] + (spread % m[owner].astype(U64)).astype(np.int64)] = 0
        empty = np.add.reduceat(empty, begin)
        most = sizes + (last[scheme] if lower else sizes * den // num)
        least = m - most * (den - num) // (den + num) - np.minimum(empty, weak[scheme])
        chosen = band >= lower
        out[scheme[chosen] & 1, np.flatnonzero(chosen)] = np.maximum(least - 1, 0)[chosen]
    return out


def _prints(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            for low, high, owner, value, sizes in _sets(batch, k):
                first, second = np.zeros(high - low, U64), np.zeros(high - low, U64)
                sketch = np.zeros((high - low, SKETCH_WORDS), U64)
                begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                full = np.flatnonzero(sizes)
                if len(full):
                    first[full] = np.bitwise_xor.reduceat(mix(value + U64(1)), begin[full])
                    second[full] = np.add.reduceat(mix(value + U64(2)), begin[full])
                    bit = (value & U64(SKETCH_WORDS * 64 - 1)).astype(np.int64)
                    np.bitwise_xor.at(sketch, (owner, bit >> 6), U64(1) << (bit & 63).astype(U64))
                flat = pa.array(sketch.reshape(-1).view(np.int64))
                even, odd = _spare(owner, value, sizes, num, den)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(high - low + 1, dtype=np.int32) * SKETCH_WORDS), flat
                        ),
                        pa.array(even),
                        pa.array(odd),
                    ],
                    ["id", "n", "f1", "f2", "sketch", "even", "odd"],
                )

    return run


def _scheme_keys(owner, value, sizes, chosen, scheme, num, den) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the chosen texts, text ``i`` under scheme ``scheme[i]``; odd ones in schemes of odd number."""
    _, _, parts, weak = bands(num, den)
    keep = chosen[owner]
    owner, value = owner[keep], value[keep]
    m = parts[scheme]
    part = (mix(value + U64(3)) % m[owner].astype(U64)).astype(np.int64)
    code = owner * int(m[chosen].max(initial=1)) + part
    order = np.argsort(code, kind="stable")
    code, owner, part, value = code[order], owner[order], part[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.bitwise_xor.reduceat(mix(value + U64(4)), first)
    who, part = owner[first], part[first]
    lean = m - np.bincount(who, minlength=len(sizes)) <= weak[scheme]
    tag = mix((scheme[who] * (1 << 32) + part + 1).astype(U64))
    keys = [(mix(key ^ tag), who)]
    thin = np.flatnonzero(chosen & ~lean)
    if len(thin):  # their empty parts count too
        who = np.repeat(thin, m[thin])
        part = np.arange(len(who)) - np.repeat(np.cumsum(m[thin]) - m[thin], m[thin])
        have = owner[first] * (1 << 32) + code[first] % int(m[chosen].max(initial=1))
        empty = ~np.isin(who * (1 << 32) + part, have)
        who, part = who[empty], part[empty]
        tag = mix((scheme[who] * (1 << 32) + part + 1).astype(U64))
        keys.append((mix(tag), who))
    key, who = np.concatenate([x[0] for x in keys]), np.concatenate([x[1] for x in keys])
    return ((key & ~U64(1)) | (scheme[who] & 1).astype(U64)).view(np.int64), who


def _keys(k: int, num: int, den: int, heavy: dict[tuple[int, int, int], int]):
    first = np.array(sorted({f[0] for f in heavy}), np.int64)

    def run(batches):
        last, most, _, _ = bands(num, den)
        for batch in batches:
            ids = batch.column(0)
            for low, high, owner, value, sizes in _sets(batch, k):
                here = ids.slice(low, high - low)
                use = (sizes > 0) & ~np.array(here.is_null())
                number = here.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(first):
                    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                    full = np.flatnonzero(use)
                    f1 = np.zeros(high - low, np.int64)
                    f2 = np.zeros(high - low, np.int64)
                    if len(full):
                        have = np.flatnonzero(sizes)
                        f1[have] = np.bitwise_xor.reduceat(mix(value + U64(1)), begin[have]).view(np.int64)
                        f2[have] = np.add.reduceat(mix(value + U64(2)), begin[have]).view(np.int64)
                    for i in np.flatnonzero(use & np.isin(f1, first)):
                        least = heavy.get((int(f1[i]), int(f2[i]), int(sizes[i])))
                        use[i] = least is None or least == number[i]
                band = np.searchsorted(last, sizes)
                for lower in (0, 1):
                    scheme = np.maximum(band - lower, 0)
                    chosen = use & (most[scheme] > 0) & (band >= lower)
                    if lower:
                        chosen &= sizes * num <= last[scheme] * den
                    if chosen.any():
                        key, who = _scheme_keys(owner, value, sizes, chosen, scheme, num, den)
                        if len(key):
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(number[who])], ["key", "id"])

    return run


def _runs(batches):
    """From rows sorted by key, those whose key has several rows, with their number, ``MANY`` at most."""
    key = who = np.zeros(0, np.int64)
    going = None  # the key of which so many rows were sent
    for batch in chain(batches, (None,)):
        if batch is not None:
            key = np.concatenate((key, batch.column(0).to_numpy()))
            who = np.concatenate((who, batch.column(1).to_numpy()))
        if not len(key):
            continue
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(start, len(key)))
        times = np.minimum(length, MANY)
        if going == key[0]:
            times[0] = MANY
        end = len(key)
        if times[-1] == MANY:
            going = key[-1]
        elif batch is not None:  # the last group may go on
            end = int(start[-1])
        times = np.repeat(times, length)[:end]
        out = times > 1
        if out.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:end][out]), pa.array(who[:end][out]), pa.array(times[out].astype(np.int32))],
                ["key", "id", "times"],
            )
        key, who = key[end:], who[end:]


def _verified(k: int, num: int, den: int):
    """Links among pairs of texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                both = pa.concat_arrays([some.column(2), some.column(3)])
                table = pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), both], ["i", "text"])
                kept = []
                for low, _, owner, value, _ in _sets(table, k):
                    kept.append((owner + low, value))
                owner = np.concatenate([x[0] for x in kept])
                value = np.concatenate([x[1] for x in kept])
                size = np.bincount(owner, minlength=len(both))
                n = len(some)
                pair, value = owner % n, value
                order = np.lexsort((value, pair))
                pair, value = pair[order], value[order]
                same = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(pair[1:][same], minlength=n)
                union = size[:n] + size[n:] - common
                link = (union > 0) & (den * common >= num * union)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).filter(pa.array(link)), some.column(1).filter(pa.array(link))], ["a", "b"]
                )

    return run


def _distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def jaccard_classes(docs: DataFrame, id_col: str, text_col: str, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row, linking sets with ``den * common >= num * union``.

    A null text, or one without words, has the empty set: size 0, linked with nothing, its
    own id as component. Rows that repeat an id count as linked with each other. A row with
    a null id keeps its size, has a null component and links nothing. Other columns of
    ``docs`` are not read. An empty table gives an empty one.
    """
    if not 0 < num < den:
        raise ValueError("the similarity must lie between 0 and 1")
    ship()
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    printed = "id bigint, n bigint, f1 bigint, f2 bigint, sketch array<bigint>, even int, odd int"
    prints = written(docs.mapInArrow(_prints(k, num, den), printed))
    rows = prints.count()
    grouped = prints.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")
    )
    classes = written(grouped)
    heavy = {
        (r.f1, r.f2, r.n): r.rep for r in classes.where(F.col("copies") > max(HEAVY // 20, rows // HEAVY)).collect()
    }  # fewer than HEAVY classes can hold so many rows each, or than 1/50 of a small table's rows
    known = written(
        prints.join(classes.drop("copies"), ["f1", "f2", "n"], "left").select(
            "id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), "even", "odd"
        )
    )

    keys = docs.mapInArrow(_keys(k, num, den, heavy), "key bigint, id bigint")
    runs = written(
        keys.repartition("key").sortWithinPartitions("key").mapInArrow(_runs, "key bigint, id bigint, times int")
    )
    release(spark)
    of_id = known.where("rep is not null").groupBy("id")
    to_class = of_id.agg(F.min("rep").alias("class"), F.min("even").alias("even"), F.min("odd").alias("odd"))
    twice = of_id.agg(F.min("rep").alias("b"), F.max("rep").alias("a"))
    odd = F.col("key").bitwiseAND(F.lit(1)) == 1
    turn = F.row_number().over(Window.partitionBy("id", odd).orderBy(F.desc("times"), F.desc("key")))
    rare = runs.join(to_class, "id").withColumn("turn", turn).where(F.col("turn") > F.when(odd, F.col("odd")).otherwise(F.col("even")))
    group = Window.partitionBy("key")
    members = written(
        rare.select("key", F.col("class").alias("id"))
        .select("key", "id", F.min("id").over(group).alias("rep"), F.max("id").over(group).alias("last"))
        .where("rep <> last")
        .select("key", "id", "rep")
        .distinct()
    )
    release(spark)
    sketches = prints.where("n > 0").select("id", "n", "sketch")
    involved = members.select("id").distinct()
    sketched = written(sketches.join(involved, "id").dropDuplicates(["id"]))
    release(spark)

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs ``(a, b)`` whose sketches allow the threshold."""
        left = sketched.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = sketched.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        total = F.col("na") + F.col("nb")
        return (
            pairs.join(left, "a")
            .join(right, "b")
            .where(F.greatest("na", "nb") * num <= F.least("na", "nb") * den)
            .where(_distance("sa", "sb") * (den + num) <= total * (den - num))
            .select("a", "b")
        )

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs)
        ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        texts = written(docs.join(ids, "id").dropDuplicates(["id"]))
        release(spark)
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(_verified(k, num, den), "a bigint, b bigint")

    star = members.where("id <> rep").select(F.greatest("id", "rep").alias("a"), F.least("id", "rep").alias("b")).distinct()
    links = written(verified(near(star)).union(twice.where("a <> b").select("a", "b")))
    labels = written(components(links))
    labelled = members.join(labels, F.col("id") == F.col("node"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("label")
    )
    of_key = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"))
    mixed = of_key.where("lo <> hi and members > 2")  # two have met
    open_ = written(labelled.join(mixed.select("key"), "key").join(sketched, "id"))
    x, y = open_.alias("x"), open_.alias("y")
    across = (
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.id") > F.col("y.id"))
            & (F.col("x.label") != F.col("y.label"))
            & (F.greatest("x.n", "y.n") * num <= F.least("x.n", "y.n") * den)
            & (_distance("x.sketch", "y.sketch") * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num)),
        )
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .distinct()
    )
    links = written(links.union(verified(across)))
    labels = written(components(links))
    return known.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "id").alias("component_id"),
    )


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents by 4-word shingles at a similarity of 0.85."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
ORACLE = {"op4_ngram_jaccard_join": sql.JACCARD}
