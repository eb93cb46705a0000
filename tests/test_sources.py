import random
import zipfile

import pytest
from pyspark.sql import functions as F

from textmill.functions.charset import decode_text
from textmill.operators.embed import HashEmbedder
from textmill.options import JobOptions, Limits
from textmill.plans.corpus import process_folder, run
from textmill.sources.archives import archive_policy, read_manifest, read_members
from textmill.sources.delimited import delimiter_profile, read_delimited, read_delimited_cells
from textmill.sources.fields import records
from textmill.sources.files import discover, extension, read_bytes, read_text, route
from textmill.sources.tables import read_tables
from textmill.streaming import ingest as streaming
from textmill.streaming.ingest import ingest, ingest_folder, stream_text


def test_extension_and_route(spark):
    names = ["a.TXT", "a.b.csv", ".txt", "noext", "x.tar.zip", "a.", "dir.d/readme"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(extension(F.col("n")).alias("e"), route(extension(F.col("n"))).alias("b"))
    assert [(r.e, r.b) for r in got.collect()] == [
        (".txt", "text"), (".csv", "table"), ("", None), ("", None), (".zip", "archive"), (".", None), ("", None),
    ]


def test_decoding(spark):
    texts = ["düz metin", "Şişli ğüı €", "a\x81\xdd", "plain"]
    data = [texts[0].encode(), texts[1].encode("cp1254"), b"a\x81\xdd", texts[3].encode()]
    got = [r.t for r in spark.createDataFrame([(d,) for d in data], "c binary").select(decode_text("c").alias("t")).collect()]
    assert got == [texts[0], texts[1], "a\x81İ", "plain"]
    every = bytes(b for b in range(0x20, 0x100) if b not in (0x81, 0x8D, 0x8E, 0x8F, 0x90, 0x9D, 0x9E))
    row = spark.createDataFrame([(every,)], "c binary").select(decode_text("c").alias("t")).first()
    assert row.t == every.decode("cp1254")


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("First one. Second one.\r\nThird.", encoding="utf-8")
    (root / "sub" / "b.TXT").write_bytes("Şimdi ığdır.".encode("cp1254"))
    (root / "t.csv").write_text("id;name;note\n1;Ali;x\n2;Veli;\n3;;\n4;a;b;c\n", encoding="utf-8")
    (root / "u.csv").write_text("only\nvalue\n", encoding="utf-8")
    (root / "p.png").write_bytes(b"x")
    (root / "d.pdf").write_bytes(b"x")
    (root / "big.txt").write_bytes(b"x" * 5000)
    with zipfile.ZipFile(root / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/", "")
        z.writestr("in/a.txt", "Inside text.")
        z.writestr("t.csv", "k,v,w\n1,2,3\n4,5,6\n")
        z.writestr("x.exe", "no")
        z.writestr("n.zip", "no")
        z.writestr("w.docx", "no")
    (root / "broken.zip").write_bytes(b"PK nothing")
    return root


def short(path):
    """Last part of a file's path, with the whole path of a member behind it."""
    file, mark, member = path.partition("!/")
    return file.rsplit("/", 1)[-1] + mark + member


def base(row):
    return short(row.source_file)


def test_discover(spark, folder):
    good, bad = discover(spark, str(folder), Limits(max_file_bytes=4000))
    assert {base(r): r.branch for r in good.collect()} == {
        "a.txt": "text", "b.TXT": "text", "t.csv": "table", "u.csv": "table", "d.pdf": "text", "z.zip": "archive", "broken.zip": "archive",
    }
    assert {base(r): r.error_code for r in bad.collect()} == {"p.png": "UNSUPPORTED_FORMAT", "big.txt": "FILE_TOO_LARGE"}
    texts = {base(r): r.text for r in read_text(spark, str(folder), Limits(max_file_bytes=4000)).collect()}
    assert texts == {"a.txt": "First one. Second one.\r\nThird.", "b.TXT": "Şimdi ığdır."}


def test_delimited(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a;a;;"x y"\n007;NA;1;"q;r"\n;;;\n1;2\n1;2;3;4;5\nnull; ;0;\x00z\n', encoding="utf-8")
    rows = read_delimited(spark, str(path)).orderBy("row_idx")
    assert rows.columns == ["source_file", "row_idx", "a", "a.1", "Unnamed: 2", "x y"]
    got = [tuple(r)[2:] for r in rows.collect()]
    assert got == [("007", None, "1", "q;r"), ("1", "2", None, None), (None, " ", "0", "z")]
    assert header_names(["a", None, "a", "a"]) == ["a", "Unnamed: 1", "a.1", "a.2"]


def header_names(cells):
    """Blanks get their position, repeats the first free running number."""
    out = []
    for i, cell in enumerate(cells):
        name, n = cell or f"Unnamed: {i}", 0
        while (f"{name}.{n}" if n else name) in out:
            n += 1
        out.append(f"{name}.{n}" if n else name)
    return out


@pytest.fixture
def tiny_splits(spark, tiny_blocks):
    """Splits of about a hundred bytes, blocks of four lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def parsed(text):
    """Rows of a table by the rules, a character at a time."""
    text = text.replace("\x00", "").removeprefix("\ufeff")
    quotes, total, rows, record = 0, text.count('"'), [], ""
    for char in text:
        quotes += char == '"'
        if char in "\r\n" and (quotes % 2 == 0 or quotes == total):
            rows.append(record)
            record = ""
        else:
            record += char
    return [r for r in [*rows, record] if r]


def cells_by_place(rows, name):
    """Cells of a file's rows in order, whatever their numbers are."""
    return [[(c.name, c.val) for c in r.cells] for r in sorted(rows, key=lambda r: r.row_idx) if r.source_file.endswith(name)]


def odd_tables(rng, count):
    alphabet = ["a", "bb", '"', '""', "\n", "\r\n", "\r", ",", ",", ";", "ş", " ", '"x\ny"', '"p,q\r\n"', "1", "NA", "\x00"]
    tables = {}
    for i in range(count):
        head = rng.choice(["a,b\n", "x;y;z\r\n", '"h\nx",k\r', "one\n", ""])
        body = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 40, 300])))
        rows = "".join(rng.choice(['1,"two\nlines"\n', "3,4\r\n", '"a""b",c\r', ";;\n", '"never closed,\n']) for _ in range(rng.choice([0, 2, 30])))
        code = rng.choice(["utf-8", "utf-8", "utf-8-sig", "cp1254", "utf-16"])
        tables[f"{rng.choice(['t', 'a b', 'p%20q', 'x+y', 'ü', '[z]'])}-{i}.csv"] = (head + body + rows).encode(code)
    return tables


def test_split_files_give_the_rows_of_whole_values(spark, tmp_path, tiny_splits):
    tables = odd_tables(random.Random(4), 60)
    tables["marks.csv"] = b"\xff\xfe" + "a,b\n1,\u0a41\u3000x\n".encode("utf-16-le")
    tables["latin9.csv"] = b"a,b\n\xdd\x81,1\nplain,2\n"
    for name, content in tables.items():
        (tmp_path / name).write_bytes(content)
    got = read_delimited_cells(spark, str(tmp_path)).collect()
    values = spark.createDataFrame(list(tables.items()), "source_file string, content binary")
    want = read_tables(values).collect()
    assert len({(r.source_file, r.row_idx) for r in got}) == len(got)
    for name in tables:
        assert cells_by_place(got, "/" + name) == cells_by_place(want, name), name
    assert len(got) > 300


def test_records_end_outside_quotes(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice('ab"\n\r,') for _ in range(rng.randint(0, 25))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", records(F.col("t")).alias("got")).collect():
        assert r.got == parsed(texts[r.i]), texts[r.i]


def test_long_cells_cross_many_splits(spark, tmp_path, tiny_splits):
    cell = "\n".join(f"line {i}, still the cell" for i in range(400))
    quoted = cell.replace('"', '""')
    (tmp_path / "t.csv").write_text(f'id,text\n1,"{quoted}"\n2,short\n3,"{quoted}"\n4,"open {quoted}\n')
    rows = read_delimited(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.id, r.text) for r in rows][:3] == [("1", cell), ("2", "short"), ("3", cell)]
    assert rows[3].id == "4" and rows[3].text.startswith('open line 0') and len(rows) == 4 + 399


def test_many_headers_are_one_plan(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.csv").write_text(f"c{i},d{i};e\n{i},x\n" if i % 2 else f"c{i};d{i}\n{i};y\n")
    rows = read_delimited_cells(spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") < 6
    got = {r.cells[0].name: r.cells[0].val for r in rows.collect()}
    assert got == {f"c{i}": str(i) for i in range(300)}


def test_row_order_of_split_files(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("n,m\n" + "".join(f"{i},x\n" for i in range(20000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_delimited(spark, str(path), sep=",")
        assert rows.rdd.getNumPartitions() > 4
        got = rows.select("row_idx", F.col("n").cast("int").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.row_idx for r in got}) == 20000
    assert [r.n for r in sorted(got, key=lambda r: r.row_idx)] == list(range(20000))


def test_utf16(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("ad,soyad\nŞule,Öz\nİnci,Ay\n".encode("utf-16"))
    got = read_delimited(spark, str(path), sep=",", encoding="UTF-16").orderBy("row_idx").collect()
    assert [(r.ad, r.soyad) for r in got] == [("Şule", "Öz"), ("İnci", "Ay")]


def test_files_of_other_headers_and_equal_names(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "t.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "b" / "t.csv").write_text("b;a;c\n5;6;7\n")
    (tmp_path / "b" / "old.csv").write_bytes("a,b\nŞule,x\n".encode("cp1254"))
    rows = read_delimited(spark, str(tmp_path)).collect()
    got = {(r.source_file.split(f"{tmp_path}/")[1], r.a, r.b, r.c) for r in rows}
    assert got == {("a/t.csv", "1", "2", None), ("a/t.csv", "3", "4", None), ("b/t.csv", "6", "5", "7"), ("b/old.csv", "Şule", "x", None)}
    cells = read_delimited_cells(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert sorted(tuple((c.name, c.val) for c in r.cells) for r in cells) == [
        (("a", "1"), ("b", "2")), (("a", "3"), ("b", "4")), (("a", "Şule"), ("b", "x")), (("b", "5"), ("a", "6"), ("c", "7")),
    ]
    assert read_delimited_cells(spark, []).count() == 0


def one_table(spark, content: bytes):
    from textmill.sources.tables import read_tables

    return read_tables(spark.createDataFrame([("f", content)], "source_file string, content binary"))


def test_delimiter_from_all_records(spark):
    cell = '"' + "x, y" * 5000 + '"'
    rows = one_table(spark, f"t\tv\n{cell}\t1\n".encode()).collect()
    assert [c.name for c in rows[0].cells] == ["t", "v"] and rows[0].cells[1].val == "1"


def test_repeated_names_differ(spark):
    from textmill.operators.row_chunks import chunk_tables

    rows = one_table(spark, b"a,a,a.1,,\n1,2,3,4,5\n6,7,8,9,0\n")
    assert [c.name for c in rows.first().cells] == header_names(["a", "a", "a.1", None, None])
    assert chunk_tables(rows)[0].first().row_data["a.1.1"] == "3"


def test_malformed_utf16_is_read_like_other_text(spark):
    good = "a,b\n1,ş\n".encode("utf-16")
    assert one_table(spark, good).first().cells[1].val == "ş"
    assert one_table(spark, "a,b\n1,😀\n".encode("utf-16-be").join([b"\xfe\xff", b""])).first().cells[1].val == "😀"
    for bad in (good + b"\x00\xd8", good + b"x", b"\xff\xfe\x00\xdc,\x00"):
        one_table(spark, bad).collect()


def test_members_of_equal_names_stay_apart(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/a.txt", "One.")
        z.writestr("y/a.txt", "Two.")
    for d in ("p", "q"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "bad.png").write_text("no")
        (tmp_path / d / "a.txt").write_text(f"Text {d}.")
    chunks, bad = process_folder(spark, str(tmp_path), JobOptions())
    got = {r.source_file.split(tmp_path.name + "/")[1]: (r.text, r.chunk_index) for r in chunks.collect()}
    assert got == {"z.zip!/x/a.txt": ("One.", 0), "z.zip!/y/a.txt": ("Two.", 0), "p/a.txt": ("Text p.", 0), "q/a.txt": ("Text q.", 0)}
    assert len({r.source_file for r in bad.collect()}) == 2


def test_delimiter_profile(spark):
    lines = [("a", "1;2;3"), ("a", "4;5;6"), ("a", '"x,y";7;8,9'), ("b", "one"), ("c", "a|b,c"), ("c", "d|e")]
    got = {r.source_file: (r.sep, r.n_fields) for r in delimiter_profile(spark.createDataFrame(lines, "source_file string, line string")).collect()}
    assert got == {"a": (";", 3), "b": (",", 1), "c": ("|", 2)}


def test_tables_of_any_header(spark):
    data = [
        ("a", 'x;y;z\n1;"q;""r""\nnew";3\n\n4;5\n6;7;8;9\n;NA;\n"é";;2\n'.encode()),
        ("b", "c,c,,d\r\n007,null,3,4\r\n,,,\r\n5".encode("utf-16")),
        ("c", b"one\nhello\n"),
        ("d", b""),
        ("e", b"a\tb\n\xdd\t1\n"),
        ("f", b"h|g\n|2\n1|\n"),
    ]
    rows = read_tables(spark.createDataFrame(data, "source_file string, content binary")).orderBy("source_file", "row_idx").collect()
    got = [(r.source_file, dict((c.name, c.val) for c in r.cells)) for r in rows]
    assert got == [
        ("a", {"x": "1", "y": 'q;"r"\nnew', "z": "3"}),
        ("a", {"x": "4", "y": "5", "z": None}),
        ("a", {"x": "é", "y": None, "z": "2"}),
        ("b", {"c": "007", "c.1": None, "Unnamed: 2": "3", "d": "4"}),
        ("b", {"c": "5", "c.1": None, "Unnamed: 2": None, "d": None}),
        ("c", {"one": "hello"}),
        ("e", {"a": "İ", "b": "1"}),
        ("f", {"h": None, "g": "2"}),
        ("f", {"h": "1", "g": None}),
    ]


def test_archives(spark, folder):
    files = read_bytes(spark, str(folder), ".zip").select("source_file", "content")
    manifest, broken = read_manifest(files)
    assert [(base(r), r.error_code) for r in broken.collect()] == [("broken.zip", "INVALID_FILE")]
    members, refused = archive_policy(manifest)
    assert {r.source_file for r in members.collect()} == {"in/a.txt", "t.csv", "w.docx"} and refused.count() == 0
    read, bad = read_members(files, members)
    assert {r.source_file: bytes(r.content) for r in read.collect()}["in/a.txt"] == b"Inside text." and bad.count() == 0
    _, refused = archive_policy(manifest, limits=Limits(max_archive_bytes=10))
    assert refused.collect()[0].error_code == "INVALID_FILE"


def test_encrypted_archive_needs_a_password(spark):
    fields = "archive string, member string, ordinal int, file_size bigint, flag_bits int, is_dir boolean"
    manifest = spark.createDataFrame([("z.zip", "a.txt", 0, 5, 1, False), ("z.zip", "b.txt", 1, 5, 0, False), ("y.zip", "c.txt", 0, 5, 8, False)], fields)
    members, refused = archive_policy(manifest)
    assert [r.source_file for r in members.collect()] == ["c.txt"]
    assert [(r.source_file, r.error_code) for r in refused.collect()] == [("z.zip", "ZIP_PASSWORD_REQUIRED")]
    assert archive_policy(manifest, has_password=True)[0].count() == 3


def test_damaged_member_fails_alone(spark, tmp_path):
    path = tmp_path / "d.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("good.txt", "good")
        z.writestr("bad.txt", "to be damaged")
    path.write_bytes(path.read_bytes().replace(b"to be damaged", b"to be dXmaged"))
    files = read_bytes(spark, str(tmp_path), ".zip").select("source_file", "content")
    read, bad = read_members(files, archive_policy(read_manifest(files)[0])[0])
    assert [r.source_file for r in read.collect()] == ["good.txt"]
    assert [(base(r), r.error_code) for r in bad.collect()] == [("d.zip!/bad.txt", "INVALID_FILE")]


def test_whole_folder(spark, folder, tmp_path):
    options = JobOptions(limits=Limits(max_file_bytes=4000), model_name="e5-base-v2")
    chunks, bad = process_folder(spark, str(folder), options, HashEmbedder(8))
    got = {(short(r.container_file), base(r), r.chunk_index): r for r in chunks.collect()}
    assert got["a.txt", "a.txt", 0].text == "First one. Second one.\nThird."
    assert got["b.TXT", "b.TXT", 0].text == "Şimdi ığdır."
    assert got["t.csv", "t.csv", 0].text == "id: 1 | name: Ali | note: x" and got["t.csv", "t.csv", 2].text == "3"
    assert got["t.csv", "t.csv", 1].row_data == {"id": "2", "name": "Veli", "note": ""}
    assert got["u.csv", "u.csv", 0].text == "only\nvalue" and not got["u.csv", "u.csv", 0].is_tabular
    assert got["z.zip", "z.zip!/in/a.txt", 0].text == "Inside text." and got["z.zip", "z.zip!/t.csv", 1].text == "k: 4 | v: 5 | w: 6"
    assert len(got) == 9 and all(len(r.embedding) == 8 for r in got.values())
    assert {(base(r), r.error_code) for r in bad.collect()} == {
        ("p.png", "UNSUPPORTED_FORMAT"), ("big.txt", "FILE_TOO_LARGE"), ("d.pdf", "INVALID_FILE"), ("broken.zip", "INVALID_FILE"),
        ("z.zip!/w.docx", "INVALID_FILE"),
    }
    run(spark, str(folder), str(tmp_path / "out"), options, HashEmbedder(8))
    assert spark.read.json(str(tmp_path / "out")).where("error is null").count() == 6


def test_stream_equals_batch(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    options = JobOptions(max_tokens=4, overlap=0)
    for round_no in range(2):
        for i in range(3):
            (source / f"r{round_no}-{i}.txt").write_text(f"One two {i}. Three four five. Six.")
        (source / f"skip{round_no}.log").write_text("no")
        ingest(stream_text(spark, str(source), options), out, mark, options).awaitTermination()
        got = spark.read.parquet(out)
        assert got.select("source_file").distinct().count() == 3 * (round_no + 1)
    assert got.count() == 12 and got.where("chunk_index = 1 and text = 'Three four five. Six.'").count() == 6


def test_stream_of_a_table_that_is_one_file_or_a_folder(spark, tmp_path):
    from conftest import SMALL
    from workload.queries import QUERIES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = tmp_path / "in [1] {a}"
    docs.repartition(3).write.parquet(str(odd / "documents.parquet"))
    schema = docs.schema
    rows = streaming.stream_table(spark, str(odd / "documents.parquet"))
    assert rows.isStreaming and rows.schema == schema
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    one = QUERIES["incremental_ingest"](spark, SMALL)
    many = QUERIES["incremental_ingest"](spark, str(tmp_path / "many"))
    assert one.count() == many.count() > 0 and one.exceptAll(many).count() == 0


def test_folder_stream_equals_the_batch_job_after_a_broken_batch(spark, folder, tmp_path, monkeypatch):
    from textmill.plans import corpus

    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    options = JobOptions(limits=Limits(max_file_bytes=4000))
    (folder / "odd [1] {2}%20+.csv").write_text('a,b\n1,"two\nlines"\n3,4\n')
    real, calls = corpus.process_folder, []

    def breaks(session, names, *rest):
        chunks, bad = real(session, names, *rest)
        calls.append(names)
        # The second batch is broken off after its chunks are written.
        return chunks, (bad if len(calls) != 2 else bad.select(F.raise_error(F.lit("lost")).alias("source_file")))

    monkeypatch.setattr(corpus, "process_folder", breaks)
    with pytest.raises(Exception, match="lost"):
        ingest_folder(spark, str(folder), out, mark, options, max_files=5).awaitTermination()
    ingest_folder(spark, str(folder), out, mark, options, max_files=5).awaitTermination()
    assert sorted(calls[1]) == sorted(calls[2])  # the broken batch came again
    (folder / "later.txt").write_text("Comes later.")
    ingest_folder(spark, str(folder), out, mark, options, max_files=5).awaitTermination()
    chunks, bad = real(spark, str(folder), options)
    columns = ["source_file", "chunk_index", "text", "token_count", "is_tabular", "container_file"]
    for kind, want, by in (("chunks", chunks, columns), ("errors", bad, ["source_file", "error_code"])):
        got = sorted(map(tuple, spark.read.parquet(f"{out}/{kind}").select(*by).collect()))
        assert got == sorted(map(tuple, want.select(*by).collect())) and got
    assert streaming._unglobbed("a[1]*") == "a\\[1\\]\\*"


def test_records_are_cut_once(spark):
    from textmill.sources.fields import cut_rows, fields

    rows = [("f", 1, "1;2", ";", ["a", "b"]), ("f", 2, "1;2;3", ";", ["a", "b"]), ("f", 3, ";NA", ";", ["a", "b"]), ("f", 4, '"x;y"', ";", ["a", "b"])]
    found = spark.createDataFrame(rows, "source_file string, row_idx int, _record string, _sep string, _names array<string>")
    cut = cut_rows(found.repartition(2))
    once = str(fields(F.col("_record"), F.col("_sep"))._jc).count("regexp_extract_all")
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == once
    got = {r.row_idx: [tuple(c) for c in r.cells] for r in cut.collect()}
    assert got == {1: [("a", "1"), ("b", "2")], 4: [("a", "x;y"), ("b", None)]}


def test_members_come_in_batches(spark, monkeypatch):
    import io
    import zipfile

    from textmill.sources import archives

    def packed(names):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for n in names:
                z.writestr(n, n * 9)
        return buffer.getvalue()

    inside = {"p.zip": [f"{i}.txt" for i in range(5)], "q.zip": ["a.txt"]}
    files = spark.createDataFrame([(k, bytearray(packed(v))) for k, v in inside.items()], "source_file string, content binary")
    wanted, _ = archives.archive_policy(archives.read_manifest(files)[0])
    for most, size in ((2, 1 << 20), (100, 1), (100, 1 << 20)):
        monkeypatch.setattr(archives, "FLUSH", most)
        monkeypatch.setattr(archives, "FLUSH_BYTES", size)
        members, bad = archives.read_members(files, wanted)
        got = sorted((r.container_file, r.source_file, bytes(r.content).decode()) for r in members.collect())
        assert got == sorted((k, n, n * 9) for k, v in inside.items() for n in v) and bad.count() == 0
