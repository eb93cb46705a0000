import random
import re

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from textmill.llm import personal_data as pd_
from textmill.llm.personal_data import find_personal_data, joined, op7_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PARTS = [
    "1", "2", "34", "4111111111111111", ".", "@", "a", "b.c", " ", "-", "+", "(", ")", "é", "😀", "255", "256", "_", "%",
    "4111-1111 1111 1111", "1.2.3.4", "x@y.z", "\n", "AKIA", "+1 (988) 555-2485", "(988) 555-2485",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def base(df):
    return df.select("doc_id", joined(F.filter("spans", lambda s: s["base"])).alias("found"), joined(F.col("spans")).alias("every"))


def test_base_spans_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(pd_, "BLOCK", 4)
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [None, "", "9" * 20_000, "a" * 100_000, "1." * 30_000, "x@y.zz " * 3000, "4111111111111111 " * 50, "+1" + "2" * 50_000, "a@b.c_d@e.f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in base(find_personal_data(df, "text", ["doc_id"])).collect():
        assert r.found == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(r.found.split(",")) <= set(r.every.split(","))


def test_all_documents(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    import hashlib

    for r in op7_personal_data(spark, SMALL).collect():
        want = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k + ":") for k in PATTERNS]


def test_added_spans(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        word = "".join(rng.choice("abcdef") for _ in range(rng.randint(3, 20)))
        digits = f"{rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        code = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, rng.choice([f"{word} token = \"{code}\" x", f"call {digits} now", f"{word} {word}", f"tel +1 {digits} ok"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.every for r in base(find_personal_data(df, "text", ["doc_id"])).collect()}
    for i, t in rows:
        if "token" in t:
            assert got[i].startswith("secret:"), t
        elif " " in t and t.split()[0] == t.split()[1]:
            assert got[i] == "", t


def test_long_credentials_and_national_numbers_are_candidates(spark):
    rng = random.Random(7)
    code = "".join(rng.choice("0123456789abcdefXYZ_") for _ in range(3000))
    secrets = [code[:n] for n in (16, 64, 65, 86, 93, 3000)] + ["x" * 70 + "1" + "y" * 20]
    phones = [
        "030 12345678", "(0171) 123 45 67", "0171/1234567", "07071 29-12345", "01 23 45 67 89", "06-12-34-56-78",
        "612 34 56 78", "912 345 678", "91 234 56 78", "020 7946 0958", "988-555-2485", "(988) 555-2485",
    ]
    rows = [(i, f'x = "{v}"; {v}', "secret", v) for i, v in enumerate(secrets)]
    rows += [(100 + i, f"Tel. {v}. Or {v}, {v}", "phone", v) for i, v in enumerate(phones)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, value string")
    for r in pd_.candidates(df, F.col("text")).collect():
        found = [r.text[s.start : s.end] for s in r._spans if pd_.KINDS[s.kind] == r.kind]
        assert found == [r.value] * (2 if r.kind == "secret" else 3), r.text


def test_reliabilities_tell_good_labelers_from_bad():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in (0.95, 0.9, 0.85, 0.55, 0.5)], axis=1).astype(int)
    share = pd_._estimate(np.full(4000, 3), votes, truth & (rng.random(4000) < 0.1), np.ones(4000))
    assert ((share > 0.5) == truth).mean() > 0.95


def test_edges(spark):
    schema = "doc_id long, text string, spans string, kind int"
    rows = [(1, None, "s", 1), (1, "", "s", 1), (None, "me@x.org", "s", 1), (2, "me@x.org", "s", 1), (2, "me@x.org", "s", 1)]
    got = base(find_personal_data(spark.createDataFrame(rows, schema), "text", ["doc_id"])).collect()
    assert sorted(r.found for r in got) == ["", "", "email:0:8", "email:0:8", "email:0:8"]
    assert find_personal_data(spark.createDataFrame([], schema), "text", ["doc_id"]).count() == 0
