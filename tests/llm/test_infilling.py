import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textmill.llm import infilling as fi


def brute(number, text, rate=90, spm_rate=20, seed=1):
    t = text or ""
    name = "" if number is None else str(number)
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(8)
    alphabet = ["a", "b ", "é", "日本", "😀", "\n", "<", ">", "P", "<P", "S>", "word", "\x00"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 40, 900, 5000]))) for _ in range(300)]
    shared = "".join(rng.choice(alphabet[:5]) for _ in range(3000))
    out += [shared, shared + "x", "y" + shared, "a" * 50_000, "é" * 50_000, None, "", "<", "x<P>y", "<S>", "a" * 4095 + "<M>" + "b" * 4095]
    out += ["z" * at + "<M>" + "q" * 200 for at in range(120, 140)]
    return out


def test_chunks_cover_texts_and_are_shared():
    data = [t.encode() for t in texts() if t]
    array = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    found = fi.chunk_ends(array, offsets)
    for ends, start, stop in zip(found, offsets[:-1], offsets[1:], strict=True):
        sizes = np.diff([start, *ends])
        assert ends[-1] == stop and (sizes <= fi.MOST).all() and (sizes[:-1] >= fi.LEAST).all()
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 40_000).astype(np.uint8).tobytes()

    def parts(x):
        ends = fi.chunk_ends(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]
        return {x[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    common = parts(body) & parts(b"some other beginning " + body)
    assert sum(map(len, common)) > 0.9 * len(body)


def test_rolling_hash_sees_the_last_32_bytes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, 100).astype(np.uint8), rng.integers(0, 256, 100).astype(np.uint8)
    b[50:] = a[50:]
    assert (fi.rolling(a)[81:] == fi.rolling(b)[81:]).all() and (fi.rolling(a)[50:75] != fi.rolling(b)[50:75]).all()


def test_against_brute_force(monkeypatch):
    for cache in (fi.CACHE_BYTES, 500):
        monkeypatch.setattr(fi, "CACHE_BYTES", cache)
        rows = texts()
        ids = [None if i == 7 else i * 31 for i in range(len(rows))]
        got = fi._transformed(90, 20, 1)(pa.array(ids, pa.int64()), pa.array(rows, pa.string())).to_pylist()
        assert [tuple(g.values()) for g in got] == [brute(i, t) for i, t in zip(ids, rows, strict=True)]
        assert {g["form"] for g in got} == {"plain", "psm", "spm"}


def test_round_trip_and_columns(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())] + [(None, "abc", "x", "y"), (5, "abc", "x", "y"), (5, "abc", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fim string, n string").repartition(3)
    done = fi.fill_in_middle(df, "doc_id", "text", rate=100, spm_rate=50, seed=9)
    assert done.columns == df.columns
    back = done.select("doc_id", "text", "fim", fi.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(back) == len(rows) and all(r.back == (r.text or "") for r in back)
    assert all(tuple(r.fim) == brute(r.doc_id, r.text, 100, 50, 9) for r in back)
    assert fi.fill_in_middle(df.where("false"), "doc_id", "text").count() == 0
