"""Line dedup by a segment-partition edit join.

Lines equal to the letter fall together by hash. Lines of at least ``min_chars`` code
points, in the query and the pipeline all that are not blank, are also compared within an
edit distance of ``tau``: a line is cut into tau + 1 segments, one of which must stand
unchanged, shifted by at most tau, in any line within that distance; segments of lines of
fewer than tau + 1 code points may be empty, and then all of that length meet. The substring indexes are aware of length and position: a line probes, for
each length from its own down by tau, only the shifts at which the edits left and right
of the segment can still add up to tau. Keys are hashes of (length, segment, substring).

Candidates pass a bigram parity sketch (an edit changes at most four bigrams, so sketches
of lines within tau differ in at most ``4 * tau`` bits) and are verified by a banded
bit-parallel edit distance: the 2 * tau + 1 diagonals around the main one are the bits of
a word, a column costs a handful of word operations.

A line goes if an equal or close line occurs before it, in order of document id and line
number. A key counts only where it is some line's index entry. Groups of a key are not
expanded: members meet the earliest of their group first; only lines that remain are held
against the earlier ones of their groups, by a semi join that lets a line go at its first hit,
in chunks of ``CHUNK`` members, each pair of chunks a group of its own. Lines that make up over
a thousandth of all lines, fewer than a thousand, send keys once. Everything is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.shared import release, written

TAU = 2
MIN_CHARS = 24
ALL_LINES = 1
HEAVY = 1000
CHUNK = 256


def _probes(tau: int) -> list[tuple[int, int, int]]:
    """``(delta, segment, shift)``: substrings of a line that can equal a segment of a line shorter by delta."""
    found = []
    for delta in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            found += [(delta, i, shift) for shift in range(low, high + 1)]
    return found


def _keys(line: Column, size: Column, tau: int) -> tuple[list[Column], list[Column]]:
    """Index entries of a line, its own segments, and the substrings with which it probes besides."""
    own, other = [], []
    for delta, i, shift in _probes(tau):
        length = size - delta
        longer = F.pmod(length, F.lit(tau + 1))
        width = ((length - longer) / (tau + 1)).cast("int")
        start = width * i + F.greatest(F.lit(0), longer + (i - (tau + 1))) + shift
        part = F.substr(line, (start + 1).cast("int"), (width + F.when(longer >= tau + 1 - i, 1).otherwise(0)).cast("int"))
        (other if delta or shift else own).append(F.xxhash64(length, F.lit(i), part))
    return own, other


def _sketch(line: Column) -> Column:
    """Parity of the line's bigrams, its end counted as a character, in 64 bits."""

    def parity(chars: Column) -> Column:
        bits = F.zip_with(
            chars,
            F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))),
            lambda a, b: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(a, b), F.lit(64))),
        )
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseXOR(b))

    # Bound by a lambda, so that the line is cut into characters once.
    return F.transform(F.array(F.split(line, "")), parity)[0]


def edit_distance_within(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``tau``; exact up to ``tau``.

    Bit ``k + tau`` of a word stands for diagonal ``k`` of the table. Vertical differences
    of neighbouring diagonals are kept as two words; per column the diagonal steps that
    cost nothing follow by one addition, and the cost along the last diagonal is summed.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    one = F.lit(1).cast("bigint")

    def shifted(c: Column, by: int) -> Column:
        return F.call_function("shiftleft", c, F.lit(by))

    def run(p: Column, t: Column) -> Column:
        delta = F.size(p) - F.size(t)

        def step(state: Column, j: Column) -> Column:
            vp0, vn0, score = state["vp"], state["vn"], state["score"]
            here = F.get(t, j - 1)
            match = F.lit(0).cast("bigint")
            for bit in range(width):
                same = F.coalesce(F.get(p, j + (bit - tau - 1)) == here, F.lit(False))
                match = match + F.when(same, F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

            def column(s: Column) -> Column:
                vp, vn, eq = s["vp"], s["vn"], s["eq"]
                x = eq.bitwiseOR(vn)
                zero = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseAND(F.lit(full).cast("bigint"))
                return F.struct(vp.alias("vp"), vn.alias("vn"), zero.alias("zero"))

            def after(s: Column) -> Column:
                vp, vn, zero = s["vp"], s["vn"], s["zero"]
                mask = F.lit(full).cast("bigint")
                up = vn.bitwiseOR(F.bitwise_not(zero.bitwiseOR(vp)))
                down = vp.bitwiseAND(zero)
                raised = shifted(up, 1)
                free = F.call_function("shiftright", zero, delta + tau).bitwiseAND(one)
                return F.struct(
                    shifted(down, 1).bitwiseOR(F.bitwise_not(zero.bitwiseOR(raised))).bitwiseAND(mask).alias("vp"),
                    raised.bitwiseAND(zero).bitwiseAND(mask).alias("vn"),
                    (score + one - free).alias("score"),
                )

            moved = F.struct(
                F.call_function("shiftright", vp0, F.lit(1)).bitwiseOR(F.lit(1 << (2 * tau)).cast("bigint")).alias("vp"),
                F.call_function("shiftright", vn0, F.lit(1)).alias("vn"),
                match.alias("eq"),
            )
            return F.transform(F.transform(F.array(moved), column), after)[0]

        start = F.struct(
            F.lit(full ^ ((1 << (tau + 1)) - 1)).cast("bigint").alias("vp"),
            F.lit((1 << (tau + 1)) - 2).cast("bigint").alias("vn"),
            F.abs(delta).cast("bigint").alias("score"),
        )
        columns = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(columns, start, step, lambda s: s["score"])

    both = F.array(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t")))
    return F.transform(both, lambda s: run(s["p"], s["t"]))[0]


def _differing(tau: int) -> Column:
    bits = F.bit_count(F.col("x_sketch").bitwiseXOR(F.col("y_sketch")))
    return (F.abs(F.col("x_size") - F.col("y_size")) <= tau) & (bits <= 4 * tau)


def _close(tau: int) -> Column:
    return edit_distance_within(F.col("x_line"), F.col("y_line"), tau) <= tau


def _sides(placed: DataFrame, gone: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier lines ``x_`` and later ones ``y_`` that are not gone yet, of every key that has any.

    The members of a key, by their order, fall into chunks of ``CHUNK``; every pair of chunks
    is a group ``(key, i, j)`` of its own, so that no task compares all of a hot key.
    """
    left = placed.where("id <> lead.id").join(gone, "id", "left_anti")  # none comes before the first of a key
    last = left.groupBy("key").agg(F.max("chunk").alias("last"))
    x = placed.join(last, "key").withColumn("j", F.explode(F.sequence("chunk", F.greatest("chunk", "last"))))
    y = left.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunk")))).withColumnRenamed("chunk", "j")
    sides = []
    for name, side in (("x", x.withColumnRenamed("chunk", "i")), ("y", y)):
        lined = side.drop("lead").join(texts.select("id", "line"), "id")
        sides.append(lined.select(*[F.col(c).alias(f"{name}_{c}") for c in ("key", "i", "j", "id", "first", "own", "size", "sketch", "line")]))
    return sides[0], sides[1]


def removed_lines(docs: DataFrame, id_col: str, text_col: str, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, removed)``: the numbers, from 0, of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\s\x1c-\x1f]")).withColumn("id", F.xxhash64("line").bitwiseAND(F.lit((1 << 63) - 1)))
    at = F.struct("doc", "no")
    occurrences = written(lines.select("doc", "no", "id", F.hash("line").alias("check")))
    firsts = written(
        occurrences.groupBy("id", "check").agg(F.min(at).alias("first"), F.count("*").alias("times"))
    )
    total = firsts.agg(F.sum("times")).first()[0] or 0
    heavy = firsts.where(F.col("times") > max(HEAVY // 20, total // HEAVY)).select(
        F.col("id").alias("h_id"), F.col("first").alias("h_first")
    )  # under HEAVY rows, as each stands for a thousandth of all lines (1/50 of a small table's)
    sized = lines.withColumn("size", F.length("line")).where(F.col("size") >= min_chars)
    sent = sized.join(F.broadcast(heavy), F.col("id") == F.col("h_id"), "left").where(
        F.col("h_first").isNull() | at.eqNullSafe(F.col("h_first"))
    )
    index, probes = _keys(F.col("line"), F.col("size"), tau)
    # Worked out in a projection, where what the keys share is computed once, and then spread.
    # Index entries have the complement of their line's id, which is negative and comes first.
    keyed = sent.select("id", F.array(*index).alias("index"), F.array(*probes).alias("probes"))
    tag = lambda i: F.when(i <= tau, F.bitwise_not("id")).otherwise(F.col("id"))
    entry = F.transform(F.concat("index", "probes"), lambda k, i: F.struct(k.alias("key"), tag(i).alias("tag")))
    keys = keyed.select(F.explode(entry).alias("k")).select("k.*")
    # A group counts if it has an index entry. Two lines close to each other always meet where
    # one of them, the shorter, has one.
    run = Window.partitionBy("key").orderBy("tag").rowsBetween(Window.unboundedPreceding, 0)
    led = keys.withColumn("lead", F.bitwise_not(F.first("tag").over(run))).where("lead >= 0")
    own = F.col("tag") < 0
    led = led.select("key", F.when(own, F.bitwise_not("tag")).otherwise(F.col("tag")).alias("id"), own.alias("own"), "lead")
    shared = written(led.where("id <> lead").groupBy("key", "id").agg(F.max("own").alias("own"), F.min("lead").alias("lead")))
    release(spark)
    leads = shared.select("key", F.col("lead").alias("id"), F.lit(True).alias("own")).distinct()
    members = shared.select("key", "id", "own").union(leads)
    involved = members.select("id").distinct()
    first = firsts.groupBy("id").agg(F.min("first").alias("first"))
    texts = written(
        # Both sides follow the corpus, whatever their sizes in a small one.
        sized.join(involved.hint("merge"), "id")
        .groupBy("id")
        .agg(F.first("line").alias("line"))
        .join(first, "id")
        .select("*", F.length("line").alias("size"), _sketch(F.col("line")).alias("sketch"))
    )
    release(spark)
    x_lines = texts.select(F.col("id").alias("x_id"), F.col("line").alias("x_line"))
    y_lines = texts.select(F.col("id").alias("y_id"), F.col("line").alias("y_line"))
    order = Window.partitionBy("key").orderBy("first", "id")
    lead = F.first(F.struct("id", "own", "size", "sketch")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    chunk = F.floor((F.row_number().over(order) - 1) / CHUNK).cast("int")
    placed = written(members.join(texts.drop("line"), "id").withColumn("lead", lead).withColumn("chunk", chunk))
    star = placed.where("id <> lead.id and (own or lead.own)").select(
        *[F.col(f"lead.{c}").alias(f"x_{c}") for c in ("id", "size", "sketch")],
        *[F.col(c).alias(f"y_{c}") for c in ("id", "size", "sketch")],
    )
    star = star.where(_differing(tau)).select("x_id", "y_id").distinct()
    star = star.join(x_lines, "x_id").join(y_lines, "y_id").where(_close(tau))
    gone = written(star.select(F.col("y_id").alias("id")).distinct())
    # The others are held against all earlier members of their groups, and go at the first hit.
    x, y = _sides(placed, gone, texts)
    meets = (F.col("x_first") < F.col("y_first")) & (F.col("x_own") | F.col("y_own")) & _differing(tau)
    group = [F.col(f"x_{c}") == F.col(f"y_{c}") for c in ("key", "i", "j")]
    later = y.join(x.hint("merge"), [*group, meets & _close(tau)], "left_semi")
    close = gone.union(later.select(F.col("y_id").alias("id"))).distinct().withColumn("close", F.lit(True))
    verdict = written(firsts.drop("times").join(close, "id", "left"))
    judged = occurrences.join(verdict, ["id", "check"])
    out = judged.where(F.coalesce("close", F.lit(False)) | ~at.eqNullSafe(F.col("first")))
    return out.groupBy(F.col("doc").alias("id")).agg(F.sort_array(F.collect_set("no")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str, text_col: str, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines removed from its text and ``n_lines``, ``n_removed`` (bigint) added.

    Lines are what ``\\n`` separates. Blank lines stay and are compared with none; lines of
    fewer than ``min_chars`` code points go only for an equal one. Of equal lines the first
    stays. A null text stays null with 0 lines, an empty one is one blank line. Rows that
    repeat an id are judged alike, each keeping what the other keeps; null ids come first
    in order. Other columns, of whatever names but those of the result, pass through. An
    empty table gives an empty one.
    """
    removed = written(removed_lines(docs, id_col, text_col, tau, min_chars).withColumnRenamed("id", "_doc"))
    release(docs.sparkSession)
    joined = docs.join(removed.hint("merge"), F.col(id_col).eqNullSafe(F.col("_doc")), "left")
    parts = F.split(F.col(text_col), "\n")
    breaks = F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
    text = F.when(
        F.col("removed").isNull() | F.col(text_col).isNull(), F.col(text_col)
    ).otherwise(F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(breaks + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: lines, of whatever length, within two edits of an earlier line go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs, "doc_id", "text", min_chars=ALL_LINES)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
