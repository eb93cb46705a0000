import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import automaton as at
from textmill.llm.secret_scan import BASE, FURTHER, RULES, Rule, Scanner, find_secrets, joined

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
PARTS = [
    "password", "PassWd", "token", "secret", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abcdef", "abc", "x", "é", "😀",
    "AKIA", "ABCDEFGH12345678", "A", "0123456789abcdef", "deadbeef", "f", "\n", ",", ".", "-", "_", "eyJ", "eyJhbGci.eyJzdWIi.c2lnbmF0dXJlX2xvbmc",
    "ghp_", "0123456789abcdefGHIJ", "https://", "user:", "pa$$word@", "host", "-----BEGIN RSA PRIVATE KEY-----", "Key", "\x00",
]


def brute(text, rules=RULES):
    out = []
    for k, rule in enumerate(rules):
        if rule.kind == "assign":
            found = [(m.start(), m.end(), len(m.group(1))) for m in ASSIGN.finditer(text or "") if "K" not in m.group()]
        else:
            pattern = re.compile(f"(?:{rule.head})({rule.value})" if rule.head else f"({rule.value})")
            found = [(m.start(), m.end(), len(m.group(m.lastindex if not rule.head else m.re.groups))) for m in pattern.finditer(text or "")]
        out += [(a, k, b) for a, b, n in found if n >= rule.least]
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(out))


def spans(texts, rules=RULES):
    scanner = Scanner(rules)
    return [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row) for row in scanner.scan(pa.array(texts, pa.string())).to_pylist()]


def test_automaton_agrees_with_the_regex_library():
    rng = random.Random(3)
    patterns = ["a(b|c)*d", "(ab|a)(c|bcd)?", "[a-c]{2,3}d?", "(a|b)+c{2}", "x?y*z+", r"\x61\.", "a{3}", "(|a)b"]
    for pattern in patterns:
        found = at.compiled([pattern])
        rows, accept = found.rows, found.accept
        for _ in range(400):
            text = "".join(rng.choice("abcdxyz.") for _ in range(rng.randint(0, 7)))
            state = 0
            for byte in text.encode():
                state = rows[state][byte]
            assert bool(accept[state]) == bool(re.fullmatch(pattern, text)), (pattern, text)


def test_automaton_is_minimal_and_tells_rules_apart():
    assert len(at.compiled(["abc|abd|abe"]).moves) == len(at.compiled(["ab[c-e]"]).moves)
    both = at.compiled(["abc", "c{2}"], search=True)
    texts = [b"xxabcc", b"abc", b"cc", b"ab", b"", b"abxc" * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for few in (0, 1000):
        at.FEW_LANES = few
        assert both.found(data, ends - [len(t) for t in texts], ends).tolist() == [3, 1, 2, 0, 0, 0]
    at.FEW_LANES = 24


@pytest.mark.parametrize("bad", ["(a", "a)", "[^a]", "\\d", "é", "a\\"])
def test_unknown_expressions_are_refused(bad):
    with pytest.raises(ValueError):
        at.compiled([bad])


def test_spans_of_odd_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += [None, "", "token=token : abcdefgh", "a" * 200_000, "password " * 20_000, "eyJ" * 30_000, "https://a:b" * 9000, "token=" + "x" * 100_000]
    got = spans(texts)
    assert got == [brute(t) for t in texts]
    assert sum(map(bool, got)) > 500


def test_each_published_form_is_found():
    forms = {
        "signed": "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJlX2xvbmc",
        "hosting": "ghp_" + "a1B2" * 9,
        "chat": "xoxb-12345678901234567890",
        "cloud": "AIza" + "Sy0-_" * 7,
        "payment": "sk_live_" + "4eC39HqLyjWDarjt",
        "private": "-----BEGIN OPENSSH PRIVATE KEY-----",
        "login": "postgres://me:hunter2@",
    }
    assert set(forms) == {r.kind for r in FURTHER}
    for kind, value in forms.items():
        assert f"{kind}:2:{2 + len(value)}" in spans([f"ü {value} x"])[0].split(","), kind
    assert [r.kind for r in BASE] == ["assign", "access", "hex"]
    assert spans(["The token of the secret is here: password reset, api keys, https://example.org:8080/a, beef."]) == [""]


def test_own_rules_and_edges(spark):
    rules = (Rule("number", "no", "[0-9]+", 2, "no[0-9]"),)
    rows = [(1, None, "s", 1), (1, "", "s", 1), (None, "no12 no3 no456", "s", 1), (2, "no12", "s", 1), (2, "no12", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string, kind int").repartition(2)
    done = find_secrets(df, "text", rules)
    assert done.columns == ["doc_id", "text", "secrets", "kind"]
    got = sorted(r[0] for r in done.select(joined(F.col("secrets"))).collect())
    assert got == ["", "", "number:0:4", "number:0:4", "number:0:4,number:9:14"]
    assert find_secrets(df.where("false"), "text").count() == 0
