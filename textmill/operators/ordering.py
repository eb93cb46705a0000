"""Positions inside a group without a single-task window.

A table may hold most of the rows of a corpus, so numbering its rows with one
window over ``source_file`` would send it to one task. Instead the rows fall into
blocks of ``BLOCK`` consecutive row ids, counts are summed per block (a partial
aggregation on the map side), running totals are taken over the blocks, and only
``(source, block)`` groups of bounded size are ever ordered. Joining on the block
also spreads the rows of a hot source over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.session import materialize

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
BLK = "_blk"
SHARES = 16  # Keys under which the name of a large source is looked up.
SPARSE_BITS = 4  # A block of sparse ids spans up to so many doublings of BLOCK ids, which bounds its rows.
WHOLE = -(1 << 62)  # The block of a source that is one block, below those of row ids.


def block_of(position: Column | str) -> Column:
    """Block number of a row id; row ids are unique within their source."""
    c = F.col(position) if isinstance(position, str) else position
    return F.shiftright(c.cast("bigint"), BLOCK_BITS)


def with_blocks(rows: DataFrame, key: str = "source_file", order: str = "row_idx") -> DataFrame:
    """Rows with the block they fall into, unless they have one.

    Ids are cut into blocks where a source has more rows than a block holds. A smaller one
    is one block whatever its ids: where ids run through all sources, as the keys of a table
    of records do, a block of ids would hold a row or two of each, and be no smaller than its
    rows. For the same reason blocks of a large source span more ids where its ids are sparse.
    Only the names of the large sources are written; the join on a share of the ids as well
    spreads a hot source.
    """
    if BLK in rows.columns:
        return rows
    ids = F.col(order).cast("bigint")
    spans = rows.groupBy(key).agg(F.count("*").alias("_n"), (F.max(ids).cast("double") - F.min(ids) + 1).alias("_span"))
    wider = F.least(F.lit(SPARSE_BITS), F.greatest(F.lit(0), F.floor(F.log2(F.col("_span") / F.col("_n")))))
    counts = spans.where(F.col("_n") > (1 << BLOCK_BITS)).withColumn("_bits", (BLOCK_BITS + wider).cast("int"))
    shares = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint")))
    large = materialize(counts.select(key, shares.alias("_share"), "_bits"))
    block = F.coalesce(F.call_function("shiftright", ids, F.col("_bits")), F.lit(WHOLE))
    shared = rows.withColumn("_share", F.pmod(block_of(order), F.lit(SHARES)).cast("bigint"))
    return shared.join(large, [key, "_share"], "left").select(*rows.columns, block.alias(BLK))


def running_totals(blocks: DataFrame, key: str, *counts: str) -> DataFrame:
    """Add ``<count>_before`` and ``<count>_total`` per key to a table of blocks.

    ``blocks`` is used twice: a written table, or one whose last step is a shuffle
    that Spark then runs once. Totals run in two levels, blocks within super-blocks and super-blocks within
    the key, so that sparse row ids cannot grow a window either.
    """
    level = blocks.withColumn("_sup", F.shiftright(BLK, BLOCK_BITS))
    inner = Window.partitionBy(key, "_sup").orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    sums = level.groupBy(key, "_sup").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    outer = Window.partitionBy(key).orderBy("_sup").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    tops = sums.select(
        key,
        "_sup",
        *[F.coalesce(F.sum(f"_{c}").over(outer), F.lit(0)).alias(f"_{c}_top") for c in counts],
        *[F.sum(f"_{c}").over(whole).alias(f"{c}_total") for c in counts],
    )
    local = level.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_{c}_in") for c in counts])
    joined = local.join(tops, [key, "_sup"])
    return joined.select(
        *blocks.columns,
        *[(F.col(f"_{c}_top") + F.col(f"_{c}_in")).alias(f"{c}_before") for c in counts],
        *[F.col(f"{c}_total") for c in counts],
    )


def dense_index(df: DataFrame, key: str, order: str, name: str, weight: Column | None = None) -> DataFrame:
    """Zero-based position of each row within ``key`` by ``order``.

    With ``weight`` the position advances by that many places per row, which
    numbers the pieces a row is about to be exploded into. Blocks that the rows have are used.
    """
    blocked = df if BLK in df.columns else df.withColumn(BLK, block_of(order))
    weighed = blocked.withColumn("_w", F.lit(1) if weight is None else weight)
    # Both uses of the counts share one shuffle, so the rows are read once for them.
    counts = weighed.groupBy(key, BLK).agg(F.sum("_w").alias("_n"))
    totals = running_totals(counts, key, "_n")
    local = Window.partitionBy(key, BLK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        weighed.join(totals.select(key, BLK, "_n_before"), [key, BLK])
        .withColumn(name, F.col("_n_before") + F.coalesce(F.sum("_w").over(local), F.lit(0)))
        .drop(BLK, "_w", "_n_before")
    )
