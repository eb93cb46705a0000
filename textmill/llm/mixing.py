"""Mixing sources to target weights by entropy balancing.

Every document of a source starts at rate 1. Among all rates between 0 and the cap that
take as many words from the source as its target asks, those of least relative entropy
are ``min(cap, exp(lambda * size))``: one multiplier per source, the solution of a convex
dual. All duals are solved at once by Newton steps, each an aggregation over the counts
of ``(source, size)`` and safeguarded by a bracket. Rates become whole copies by rounding
running totals from the largest size to the smallest, and what is still missing or too
much is made up with the smallest documents.

Documents are only counted, joined and numbered; running totals go over the aggregated
table of sizes, and cells of many equal sizes are numbered in salted parts. Sums inside
the iterations are decimals, so that a rerun gives the same copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.shared import written

WORDS = r"[^\x20\x09-\x0D]+"
PART = 4096
TOLERANCE = 1e-7
MOST_STEPS = 200


def _key(source: str) -> Column:
    """Joinable also where the source is null."""
    return F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))


def _total(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def _targets(cells: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """``(key, source_size, target, low, scale)``: water filling over one row per source.

    A source is at its cap when the words left for it and all sources of a larger ratio
    of cap to weight, dealt by weight, would exceed that cap.
    """
    sources = cells.groupBy("key").agg(
        F.first("source").alias("source"),
        F.sum(F.col("size") * F.col("docs")).alias("source_size"),
        F.sum("docs").alias("n"),
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    weighed = weighed.withColumn("most", (F.col("source_size") * cap).cast("double"))
    rest = Window.orderBy((F.col("most") / F.col("weight")), "key").rowsBetween(0, Window.unboundedFollowing)
    before = Window.orderBy((F.col("most") / F.col("weight")), "key").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = weighed.select(
        "*",
        F.sum("source_size").over(every).cast("double").alias("total"),
        F.sum("weight").over(rest).alias("open"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("gone"),
    ).withColumn("capped", (F.col("total") - F.col("gone")) / F.col("open") * F.col("weight") >= F.col("most"))
    shared = full.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(every), F.lit(0.0)).alias("fixed"),
        F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every).alias("free"),
    )
    return shared.select(
        "key",
        "source_size",
        F.when(F.col("capped"), F.col("most"))
        .otherwise((F.col("total") - F.col("fixed")) / F.col("free") * F.col("weight"))
        .alias("target"),
        F.coalesce(F.col("least"), F.lit(1)).alias("least"),
        (F.greatest(F.col("source_size"), F.lit(1)) / F.col("n")).alias("scale"),
        "capped",
    )


def _rate(cap: int) -> Column:
    tilt = F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))
    return F.when(F.col("capped"), F.lit(float(cap))).otherwise(tilt)


def _solved(cells: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """``targets`` with the multiplier ``lam`` of each source."""
    goal, size = F.col("target"), F.col("source_size")
    ratio = F.when((size > 0) & (goal > 0), goal / size).otherwise(F.lit(1.0))
    edge = F.col("scale") / F.col("least")
    state = written(
        targets.select(
            "*",
            F.when(ratio < 1, F.log(ratio) * edge).otherwise(F.lit(0.0)).alias("lo"),
            F.when(ratio > 1, F.lit(math.log(cap)) * edge).otherwise(F.lit(0.0)).alias("hi"),
            F.lit(0.0).alias("lam"),
            (F.col("capped") | (size == 0)).alias("done"),
        )
    )
    for _ in range(MOST_STEPS):
        u = F.col("size") / F.col("scale")
        taken = F.col("docs") * F.col("size") * _rate(cap)
        sums = (
            cells.join(state.where("not done").select("key", "lam", "scale", "capped"), "key")
            .groupBy("key")
            .agg(_total(taken).alias("taken"), _total(F.when(_rate(cap) < cap, taken * u)).alias("slope"))
        )
        off = F.col("taken") - goal
        lo = F.when(off <= 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - off / F.col("slope")
        good = (F.col("slope") > 0) & (newton > F.col("lo2")) & (newton < F.col("hi2"))
        near = F.abs(off) <= goal * TOLERANCE
        flat = (F.col("hi2") - F.col("lo2")) <= F.abs(F.col("lam")) * 1e-14
        state = written(
            state.join(sums, "key", "left")
            .withColumns({"lo2": lo, "hi2": hi})
            .select(
                *targets.columns,
                F.when(F.col("done"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
                F.when(F.col("done"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
                F.when(F.col("done") | near, F.col("lam"))
                .when(good, newton)
                .otherwise((F.col("lo2") + F.col("hi2")) / 2)
                .alias("lam"),
                (F.col("done") | near | flat).alias("done"),
            )
        )
        if state.where("not done").isEmpty():
            break
    return state


def _rounded(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """Copies ``n`` of each ``(key, size)`` cell, the whole source near its target."""
    rated = cells.drop("source").join(state, "key").withColumn("rate", _rate(cap))
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    run = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    total = F.floor(F.sum((F.col("docs") * F.col("rate")).cast("decimal(38,9)")).over(run) + F.lit(0.5))
    counted = rated.withColumn("upto", total.cast("bigint"))
    counted = counted.withColumn("n0", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
    missing = counted.withColumn("miss", F.col("target") - F.sum(F.col("n0") * F.col("size")).over(whole))
    room = F.when(F.col("size") == 0, 0).when(F.col("miss") > 0, F.col("docs") * cap - F.col("n0")).otherwise(F.col("n0"))
    up = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    missing = missing.withColumn("room", room)
    left = F.abs("miss") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(up), F.lit(0))
    step = F.greatest(F.lit(0), F.least(F.col("room"), F.floor(left / F.greatest("size", F.lit(1))).cast("bigint")))
    return missing.select(
        "key",
        "size",
        "docs",
        "rate",
        "source_size",
        "target",
        (F.col("n0") + F.when(F.col("miss") > 0, step).otherwise(-step)).alias("n"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: int = 3,
) -> DataFrame:
    """``(id, source, size, source_size, target, rate, copies, taken)`` per row of ``docs``.

    ``size`` counts words (0 for a null or empty text). Sources in order of their code
    points, null last as a source of its own, carry ``weights`` in turn and share all
    words; a target stops at ``cap`` times its source's words, the rest is reshared by
    weight. A document without words keeps rate 1 (or the cap) and takes 0 words. Among
    documents of one source and size, those of the smallest hash of their id take the odd
    copies; repeated rows are numbered like others. Columns of other names are not read;
    an empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("bigint")
    sized = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn(
            "key", _key("source")
        )
    )
    cells = written(
        sized.groupBy("key", "size").agg(F.first("source").alias("source"), F.count("*").alias("docs"))
    )
    state = _solved(cells, written(_targets(cells, weights, cap)), cap)
    rounded = written(_rounded(cells, state, cap))
    spread = sized.withColumn("h", F.xxhash64("id")).join(rounded, ["key", "size"])
    spread = spread.withColumn("part", F.pmod("h", 1 + F.floor(F.col("docs") / PART)))
    parts = spread.groupBy("key", "size", "part").agg(F.count("*").alias("in_part"))
    earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "key", "size", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before")
    )
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h", "id")) + F.col("before")
    odd = F.when(place <= F.col("n") % F.col("docs"), 1).otherwise(0)
    copies = (F.floor(F.col("n") / F.col("docs")) + odd).cast("bigint")
    return spread.join(parts, ["key", "size", "part"]).select(
        "id",
        "source",
        "size",
        "source_size",
        "target",
        "rate",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    Rows of equal id, source and size share their copies evenly, the first by the hash
    of the text taking the odd ones.
    """
    plan = (
        mix_sources(docs, id_col, text_col, source_col, **options)
        .withColumn("_key", _key("source"))
        .groupBy(F.col("id").alias("_id"), "_key", F.col("size").alias("_size"))
        .agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    )
    plan = written(plan)
    # Columns of whatever names stand apart from those worked with.
    names = docs.columns
    places = [f"c{i}" for i in range(len(names))]
    docs = docs.toDF(*places)
    id_col, text_col, source_col = (places[names.index(c)] for c in (id_col, text_col, source_col))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("bigint")
    # The same columns for both joins, so that the texts are dealt out once.
    own = docs.withColumns({"_own": _key(source_col), "_words": size})
    once = plan.where("_rows = 1")
    condition = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")) & (F.col("_words") == F.col("_size"))

    def repeated(rows: DataFrame, copies: Column) -> DataFrame:
        times = F.explode(F.array_repeat(F.lit(1), copies.cast("int")))
        return rows.withColumn("_copies", copies).where("_copies > 0").withColumn("_one", times).select(*docs.columns)

    alone = repeated(own.join(once, condition), F.col("_all"))
    turn = F.row_number().over(Window.partitionBy("_id", "_key", "_size").orderBy(F.xxhash64(text_col)))
    many = own.join(plan.where("_rows > 1"), condition).withColumn("_turn", turn)
    shared = F.floor(F.col("_all") / F.col("_rows")) + F.when(F.col("_turn") <= F.col("_all") % F.col("_rows"), 1).otherwise(0)
    return alone.union(repeated(many, shared)).toDF(*names)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 and at most three copies of each."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


QUERIES = {"op1_mix_sources": op1_mix_sources}
