import random

import pytest
from pyspark.sql import functions as F

from textmill.functions.text import strip
from textmill.operators import ordering
from textmill.operators.layout import CellArray, Columns, layout_of
from textmill.operators.ordering import dense_index
from textmill.operators.row_chunks import chunk_rows, chunk_tables, char_token_ratio, context_prefix, split_row
from textmill.operators.row_text import missing_to_null, row_map, row_text
from textmill.operators.table_clean import (
    cut_sparse_rows,
    drop_blank_rows,
    drop_null_columns,
    row_cap,
    source_profile,
    table_gate,
    table_profile,
)
from textmill.options import JobOptions, Limits

ABC = "source_file string, row_idx bigint, a string, b string, c string"


def rows_of(spark, *rows, source="t.csv"):
    return spark.createDataFrame([(source, i, *r) for i, r in enumerate(rows)], ABC)


def as_cells(df):
    names = [c for c in df.columns if c not in ("source_file", "row_idx")]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("val")) for n in names])
    return df.select("source_file", "row_idx", cells.alias("cells"))


@pytest.mark.parametrize("shape", [lambda d: d, as_cells])
def test_row_text(spark, shape):
    df = shape(rows_of(spark, ("1", "x", "y"), ("1", "", "y"), ("", " ", None), (" 1", "x ", "Y ")))
    layout = layout_of(df)
    named = df.select(row_text(layout).alias("t")).collect()
    assert [r.t for r in named] == ["a: 1 | b: x | c: y", "1 | y", "", "a:  1 | b: x  | c: Y"]
    bare = df.select(row_text(layout, include_column_names=False, normalization="uppercase").alias("t")).collect()
    assert [r.t for r in bare] == ["1 | X | Y", "1 | Y", "", "1 | X  | Y"]
    one = df.select(row_text(layout, output_text_column="c", normalization="lowercase").alias("t")).collect()
    assert [r.t for r in one] == ["y", "y", "", "y"]
    absent = df.select(row_text(layout, output_text_column="zzz").alias("t")).collect()
    assert absent[0].t == "a: 1 | b: x | c: y"
    assert drop_blank_rows(df).count() == 3
    kept = F.array(F.lit("a"), F.lit("c"))
    assert df.select(row_map(layout, kept).alias("m")).collect()[1].m == {"a": "1", "c": "y"}


def test_layouts_agree(spark):
    df = rows_of(spark, ("1", None, "y"), (None, None, " "))
    assert isinstance(layout_of(df), Columns) and isinstance(layout_of(as_cells(df)), CellArray)
    for shape in (df, as_cells(df)):
        layout = layout_of(shape)
        got = source_profile(table_profile(shape, layout, JobOptions(output_text_column="a"))).collect()[0]
        assert (got.n_rows, got.n_text, got.header, got.kept) == (2, 1, ["a", "b", "c"], ["a", "c"])
        assert [r[0] for r in shape.select(layout.filled()).collect()] == [2, 0]
        assert [r[0] for r in shape.select(layout.line(" | ")).collect()] == ["1 |  | y", " |  |  "]


def test_cleanup(spark):
    df = rows_of(spark, ("1", None, "y"), (None, None, "z"))
    assert drop_null_columns(df).columns == ["source_file", "row_idx", "a", "c"]
    na = spark.createDataFrame([("NA",), ("",), ("n/a",), ("0",), ("None",), ("none",)], "v string")
    assert [r.v for r in na.select(missing_to_null(F.col("v")).alias("v")).collect()] == [None, None, None, "0", None, "none"]


def test_gate_and_cap(spark):
    two, one = rows_of(spark, ("1", "x", "y"), ("2", "x", "y")), rows_of(spark, ("1", "x", "y"), source="u.csv")
    df = two.unionByName(one)
    source = source_profile(table_profile(df, layout_of(df)))
    assert {r.source_file: r.is_table for r in table_gate(source, 2, 2).collect()} == {"t.csv": True, "u.csv": False}
    assert not any(r.is_table for r in table_gate(source, 4, None).collect())
    kept, bad = row_cap(df, Limits(max_table_rows=1))
    assert [r.source_file for r in kept.collect()] == ["u.csv"]
    error = bad.collect()[0]
    assert error.error_code == "TOO_MANY_ROWS" and error.message.endswith("2 (limit: 1)")


@pytest.mark.parametrize("sparse,kept", [(49, 60), (50, 50), (51, 50)])
def test_sparse_run(spark, sparse, kept):
    cells = [("x", "y", "z")] * 50 + [("x", None, " ")] * sparse + [("x", "y", None)] * 10
    df = rows_of(spark, *cells)
    assert cut_sparse_rows(df).count() == kept
    assert cut_sparse_rows(as_cells(df)).count() == kept


def test_sparse_runs_across_blocks(spark, tiny_blocks):
    rng = random.Random(2)
    data, want = [], set()
    for s in range(12):
        ids = sorted(rng.sample(range(400), 60))
        flags = [rng.random() < 0.75 for _ in ids]
        run = 0
        for i, sparse in zip(ids, flags):
            data.append((f"s{s}", i, "x", None if sparse else "y"))
        for i, sparse in zip(ids, flags):
            run = run + 1 if sparse else 0
            if run == 6:
                break
            if not sparse:
                want.add((f"s{s}", i))
    df = spark.createDataFrame(data, "source_file string, row_idx bigint, a string, b string").repartition(3)
    assert {(r.source_file, r.row_idx) for r in cut_sparse_rows(df, run=6).collect()} == want


def test_dense_index_across_blocks(spark, tiny_blocks):
    rng = random.Random(4)
    data = [(s, i) for s in "ab" for i in rng.sample(range(3000), 150)]
    df = spark.createDataFrame(data, "source_file string, row_idx bigint").repartition(3)
    weight = (F.col("row_idx") % 3).cast("int")
    for r in dense_index(df, "source_file", "row_idx", "pos").collect():
        assert r.pos == sum(1 for s, i in data if s == r.source_file and i < r.row_idx)
    for r in dense_index(df, "source_file", "row_idx", "pos", weight).collect():
        assert r.pos == sum(i % 3 for s, i in data if s == r.source_file and i < r.row_idx)


def test_ratio_samples_every_nth_row(spark, tiny_blocks):
    rng = random.Random(9)
    texts = ["w" * rng.randrange(1, 9) + (" v" * rng.randrange(4)) for _ in range(517)]
    df = spark.createDataFrame([("t", 3 * i, t, None) for i, t in enumerate(texts)], "source_file string, row_idx bigint, a string, b string")
    sample = texts[:: len(texts) // 100][:100]
    want = sum(map(len, sample)) / sum(len(t.split()) for t in sample)
    assert char_token_ratio(df, JobOptions()).collect()[0].ratio == pytest.approx(want)
    empty = spark.createDataFrame([("t", 0, " ", None)], "source_file string, row_idx bigint, a string, b string")
    assert char_token_ratio(empty, JobOptions()).collect()[0].ratio == 4.0


def cut_by_hand(text: str, prefix: str, cpc: int) -> list[str]:
    """Take a window off the front, up to its last space unless it is the rest."""
    found = []
    while text:
        window = text[: max(cpc - len(prefix), cpc // 2) if found else cpc]
        if len(window) < len(text) and " " in window[1:]:
            window = window[: window.rindex(" ") + 1]
        text = text[len(window) :]
        if window.strip():
            found.append((prefix if found else "") + window.strip())
    return found


def test_split_row_by_hand(spark):
    rng = random.Random(6)
    cases = []
    for _ in range(150):
        words = ["x" * rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))]
        cases.append((" ".join(words).replace("xxxx ", "xxxx   "), "p" * rng.randrange(0, 6), rng.randrange(8, 60)))
    df = spark.createDataFrame(cases, "t string, p string, n int")
    got = df.select("t", "p", "n", split_row(strip("t"), F.col("p"), F.col("n")).alias("s")).collect()
    for r in got:
        assert r.s == cut_by_hand(r.t.strip(), r.p, r.n)


def test_row_of_buffer_size_is_not_split(spark):
    """Ratio 5 and 20 tokens: 110 characters pass, 111 are split."""
    filler = [("abcd efghi", "", "")] * 1
    for length, pieces in ((110, 1), (111, 2)):
        text = ("abcd " * 30)[: length - 1] + "x"
        # Every row averages five characters per word.
        df = rows_of(spark, (text, None, None), *filler)
        ratio = char_token_ratio(df, JobOptions()).collect()[0].ratio
        got = chunk_rows(df, JobOptions(max_tokens=20, overlap=0)).where("row_idx = 0").orderBy("chunk_index").collect()
        limit = int(20 * ratio * 1.1)
        assert (len(got) == 1) == (length <= limit)
        assert all(r.row_split == (length > limit) and r.single_row != r.row_split for r in got)


def test_context_prefix(spark):
    row = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("val")) for n, v in [("a", " 1 "), ("b", "y" * 34), ("c", "zz"), ("d", "q" * 20)]])
    df = spark.range(1)
    assert df.select(context_prefix(row, F.lit(100), True).alias("p")).first().p == "a: 1 | c: zz | "
    assert df.select(context_prefix(row, F.lit(100), False).alias("p")).first().p == "1 | zz | "
    assert df.select(context_prefix(row, F.lit(8), True).alias("p")).first().p == ""


@pytest.mark.parametrize("shape", [lambda d: d, as_cells])
def test_chunk_rows_numbers_across_blocks(spark, tiny_blocks, shape):
    rng = random.Random(8)
    data = []
    for s in ("big.csv", "small.csv"):
        for i in range(60 if s == "big.csv" else 3):
            data.append((s, i * 5, f"k{i}", None if i % 4 == 0 else "v", " ".join("t" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40)))))
    df = shape(spark.createDataFrame(data, ABC).repartition(3))
    got = chunk_rows(df, JobOptions(max_tokens=10, overlap=0)).collect()
    for s in ("big.csv", "small.csv"):
        mine = sorted((r.chunk_index, r.row_idx) for r in got if r.source_file == s)
        assert [i for i, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)
    assert {r.row_idx for r in got if r.source_file == "big.csv"} == {i * 5 for i in range(60)}
    assert all(set(r.row_data) == {"a", "b", "c"} and r.extra_metadata == r.row_data and r.table_type == "csv" for r in got)


def test_flags_leave_row_data_out(spark):
    df = rows_of(spark, ("1", "x", None), ("2", "y", None))
    got = chunk_rows(df, JobOptions(attach_row_data=False)).collect()[0]
    assert got.row_data is None and got.extra_metadata == {"a": "1", "b": "x"} and got.table_columns == ["a", "b"]
    assert chunk_rows(df, JobOptions(flatten_row_values_to_root=False)).collect()[0].extra_metadata is None


def test_tables_that_fail_the_gate_become_text(spark):
    df = rows_of(spark, ("1", "", "y"))
    chunks, bad = chunk_tables(df, JobOptions())
    row = chunks.collect()[0]
    assert row.text == "a | b | c\n1 | | y" and not row.is_tabular and row.sentence_aware and bad.count() == 0
    _, bad = chunk_tables(df, JobOptions(limits=Limits(max_file_bytes=3)))
    assert bad.collect()[0].error_code == "FILE_TOO_LARGE"
    chunks, bad = chunk_tables(rows_of(spark, ("1", "x", "y"), ("2", "x", "y")), JobOptions(limits=Limits(max_table_rows=1)))
    assert chunks.count() == 0 and bad.collect()[0].error_code == "TOO_MANY_ROWS"


def sheets(spark, n: int, sources: int):
    """Rows whose ids run through all sources, some blank or without a note."""
    k = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("s"), k % sources).alias("source_file"),
        (k * 7).alias("row_idx"),
        F.when(k % 11 == 0, F.lit(" \u2003")).otherwise(F.concat(F.lit("a b "), k)).alias("a"),
        F.when((k % 3 > 0) & (k % sources > 2), F.concat_ws(" ", F.lit("x"), k % 5, F.repeat(F.lit("y "), (k % 13).cast("int")))).alias("note"),
    )


def test_ids_through_all_sources_make_one_block_each(spark):
    from textmill.operators.ordering import with_blocks

    df = sheets(spark, 40_000, 1000)
    # 40 rows each, in 69 blocks of ids.
    profile = table_profile(df, layout_of(df))
    assert profile.count() == 1000 and {r.n_rows for r in profile.collect()} == {40}
    got = chunk_tables(df, JobOptions(min_rows_for_table=40))[0].groupBy("source_file").agg(F.max("chunk_index").alias("last"), F.count("*").alias("n"))
    assert all(r.last == r.n - 1 for r in got.collect())
    # A source of more rows than a block holds keeps its blocks of ids.
    big = with_blocks(sheets(spark, 10_000, 2).unionByName(df.where("source_file = 's9'")))
    assert big.groupBy("source_file").agg(F.countDistinct("_blk").alias("n")).orderBy("source_file").collect() == [("s0", 3), ("s1", 3), ("s9", 1)]
    # Ids 14 apart: blocks of 8 * 4,096 ids. Dense ones keep blocks of 4,096.
    dense = with_blocks(spark.range(3, 10_000).selectExpr("'t' source_file", "id row_idx", "'x' a"))
    assert [r.n for r in dense.groupBy("_blk").agg(F.count("*").alias("n")).orderBy("_blk").collect()] == [4093, 4096, 1808]
    # Gaps cannot make a block grow beyond 16 * 4,096 ids.
    gap = with_blocks(spark.range(200_000).selectExpr("'t' source_file", "id + if(id > 150000, 1L << 50, 0L) row_idx", "'x' a"))
    assert max(r["count"] for r in gap.groupBy("_blk").count().collect()) == 65_536


@pytest.mark.parametrize("options", [JobOptions(), JobOptions(output_text_column="note", normalization="uppercase")])
def test_measured_and_sampled_ratios_agree(spark, monkeypatch, options):
    df = sheets(spark, 1500, 20)
    both = []
    for bits in (12, 2):  # Sources of 75 rows: one block each, then many.
        monkeypatch.setattr(ordering, "BLOCK_BITS", bits)
        ratios = {r.source_file: r.ratio for r in char_token_ratio(df, options).collect()}
        chunks = chunk_rows(df, options).select("source_file", "chunk_index", "row_idx", "text", "token_count").collect()
        both.append((ratios, sorted(map(tuple, chunks))))
    assert both[0] == both[1] and len(both[0][0]) == 20 and len(set(both[0][0].values())) > 3


def test_loose_rows_of_small_and_large_sources(spark, monkeypatch):
    df = sheets(spark, 300, 3).unionByName(sheets(spark, 12, 4).withColumn("source_file", F.concat(F.lit("t"), "source_file")))
    monkeypatch.setattr(ordering, "BLOCK_BITS", 4)
    got = chunk_tables(df, JobOptions(min_cols_for_table=5, max_tokens=32768, overlap=0))[0].collect()
    lines = {}
    for r in df.orderBy("row_idx").collect():
        lines.setdefault(r.source_file, ["a | note"]).append(f"{r.a} | {r.note or ''}")
    for source, mine in lines.items():
        texts = [r.text for r in sorted(got, key=lambda r: r.chunk_index) if r.source_file == source]
        assert len(texts) == (7 if source[0] == "s" else 1)
        assert "".join("\n".join(texts).split()) == "".join("\n".join(mine).split())


def test_empty_table(spark):
    chunks, bad = chunk_tables(rows_of(spark).limit(0), JobOptions())
    assert chunks.count() == 0 and bad.count() == 0


def test_block_size_is_bounded():
    assert ordering.BLOCK == 1 << ordering.BLOCK_BITS <= 1 << 16


def test_no_limits_by_default(spark):
    from textmill.options import JobOptions, Limits

    assert Limits() == Limits(None, None, None)
    df = spark.range(600_000).selectExpr("'t' source_file", "id row_idx", "cast(id as string) a", "'x' b")
    chunks, bad = chunk_tables(df, JobOptions(attach_row_data=False, flatten_row_values_to_root=False))
    assert chunks.count() == 600_000 and bad.count() == 0


def test_long_narrow_table_is_chunked_by_blocks(spark, tiny_blocks):
    rows = [("t", i, f"Line {i} ends.") for i in range(11)] + [("u", 0, "only")]
    df = spark.createDataFrame(rows, "source_file string, row_idx long, a string")
    got = chunk_tables(df, JobOptions(max_tokens=1000, overlap=0))[0].collect()
    by = {(r.source_file, r.chunk_index): r.text for r in got}
    assert sorted(by) == [("t", 0), ("t", 1), ("t", 2), ("u", 0)]
    assert "\n".join(by["t", i] for i in range(3)) == "a\n" + "\n".join(r[2] for r in rows[:11]) and by["u", 0] == "a\nonly"
