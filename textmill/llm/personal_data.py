"""Personal data by weak supervision.

Candidate spans come from patterns: the base patterns, whose matches always stay, and
looser ones for telephone numbers in the grouped forms of several countries and for
credentials of any length. Labelers vote on
every candidate: a strict pattern, a checksum or shape, a gazetteer of words around it, a
gazetteer of endings and prefixes, and the characters next to it; each says yes, no, or
nothing. Candidates are counted by kind, votes and length class, a table whose size is
bounded by their number of combinations. On it expectation-maximisation estimates how
reliable each labeler is and how likely each combination is a true span, base matches being
known as true; a logistic classifier over votes, kind and length class is trained on these
probabilities and decides on the spans that the looser patterns add.

Texts are read once, by built-in functions of strings and arrays; spans are a column next to the
document, so nothing is shuffled but the counts. Patterns use possessive quantifiers and start
where a run of their characters starts, so that long runs cost one pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import written

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    # As given, written without backtracking: a match starts at the start of a run or where the last ended.
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # Chains of fewer than 13 digits fail anyhow; a chain tried from its middle has fewer still.
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
APART = r"(?:\x20?[./-]\x20?|\x20)"
ALONE = r"(?<![0-9+])(?<![0-9][.,/-])"
GROUPS = rf"[0-9]{{2,8}}+(?:{APART}[0-9]{{2,8}}+){{0,5}}+(?![0-9]|[.,/-][0-9])"
#: With the numbers of digits that count, where they matter; what an earlier one found is no candidate of a later one.
LOOSE = (
    ("phone", rf"{ALONE}\(?[0-9]{{3}}\)?[\x20.-][0-9]{{3}}[\x20.-][0-9]{{4}}(?![0-9]|[.,-][0-9])", None),
    # Groups of digits behind a trunk zero, as in German, French or British numbers.
    ("phone", rf"{ALONE}(?:\(0[1-9][0-9]{{0,4}}+\)\x20?[./-]?\x20?|0[1-9][0-9]{{0,4}}+{APART}){GROUPS}", (7, 15)),
    # Spanish numbers have no trunk zero, nine digits, and begin with 5 to 9.
    ("phone", rf"{ALONE}(?:\([5-9][0-9]{{1,2}}+\)\x20?[./-]?\x20?|[5-9][0-9]{{1,3}}+{APART}){GROUPS}", (9, 9)),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+", None),
)
DATE = r"^(?:[0-9]{1,2}([./ -])[0-9]{1,2}\1[0-9]{2,4}|[0-9]{4}([./ -])[0-9]{2}\2[0-9]{2})$"
#: What must occur for a pattern to match at all; spares most texts the pattern.
NEEDED = {"email": "@", "phone": "+"}
NEAR = 24
WORDS_FOR = {
    "email": "mail|contact|write|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": "card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|\btel\b|call|mobile|\bfax\b|telefon|t[ée]l[ée]phone|tel[ée]fono",
    "secret": "password|passwd|token|secret|api|key|credential|auth",
}
WORDS_AGAINST = r"isbn|issn|\bdoi\b|version|order|invoice|page|\bfig"
LABELERS = ("strict", "shape", "words", "ending", "edges")
BLOCK = 64


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _before(steps: Column) -> Column:
    """Sum of the elements before each; in blocks, so that no growing array is long."""
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<bigint>")

    def running(a: Column) -> Column:
        start = F.struct(zero.alias("sum"), none.alias("all"))
        grow = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["all"], s["sum"]).alias("all"))
        return F.aggregate(a, start, grow, lambda s: s["all"])

    def blocks(a: Column) -> Column:
        count = F.ceil(F.size(a) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))
        sums = running(F.transform(cut, lambda p: F.aggregate(p, zero, lambda s, x: s + x)))
        return F.flatten(F.zip_with(cut, sums, lambda p, s: F.transform(running(p), lambda x: x + s)))

    return _let(steps, lambda a: F.when(F.size(a) > BLOCK, blocks(a)).otherwise(running(a)))


def matches(text: Column, pattern: str, needed: str | None = None) -> Column:
    """``array<struct<value, before, after, start, end>>`` of a pattern's matches, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needed:
        hits = F.when(F.contains(text, F.lit(needed)), hits).otherwise(F.array().cast("array<string>"))

    def placed(s: Column) -> Column:
        hit, part = s["hits"], s["parts"]
        steps = F.transform(hit, lambda h, i: (F.length(h) + F.length(F.get(part, i))).cast("bigint"))

        def one(h: Column, i: Column, ahead: Column) -> Column:
            start = F.get(ahead, i) + F.length(F.get(part, i))
            return F.struct(
                h.alias("value"),
                F.substring(F.get(part, i), -NEAR, NEAR).alias("before"),
                F.substring(F.get(part, i + 1), 1, 1).alias("after"),
                start.alias("start"),
                (start + F.length(h)).alias("end"),
            )

        return _let(_before(steps), lambda ahead: F.transform(hit, lambda h, i: one(h, i, ahead)))

    def located(h: Column) -> Column:
        both = F.struct(h.alias("hits"), F.split(text, pattern, -1).alias("parts"))
        return F.when(F.size(h) > 0, _let(both, placed))

    empty = "array<struct<value:string,before:string,after:string,start:bigint,end:bigint>>"
    return F.coalesce(_let(hits, located), F.array().cast(empty))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        number = F.translate(value, " -", "")
        return (F.length(number) <= 19) & F.call_function("luhn_check", number)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, m: Column, base: bool) -> list[Column]:
    """1 for yes, 0 for no, -1 for nothing, by labeler."""
    value, near = m["value"], F.lower(m["before"])
    yes, no, nothing = F.lit(1), F.lit(0), F.lit(-1)
    if kind == "secret":
        strict = F.when(value.rlike(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64})$"), yes).otherwise(nothing)
        mixed = value.rlike("[0-9].*[0-9].*[0-9]") & value.rlike("[A-Za-z]")
        shape = F.when(mixed, yes).otherwise(no)
        ending = F.when(m["before"].rlike(r"[=:]\s*[\"']?$"), yes).otherwise(nothing)
    else:
        strict = yes if base else nothing
        shape = {
            "card": F.when(F.call_function("luhn_check", _digits(value)), yes).otherwise(no),
            "phone": F.when(
                F.length(_digits(value)).between(10 if base else 9, 15) & (F.lit(base) | ~value.rlike(DATE)), yes
            ).otherwise(no),
            "ip": F.when(value.rlike(r"(?:^|\.)0[0-9]"), no).otherwise(yes),
            "email": F.when(F.length(value) <= 254, yes).otherwise(no),
        }[kind]
        ending = {
            "card": F.when(_digits(value).rlike("^(?:3[47]|4|5[1-5]|6)"), yes).otherwise(no),
            "phone": F.when(value.rlike(r"^(?:\+|\(?(?:0[1-9]|[2-9]))"), yes).otherwise(no),
            "ip": F.when(value.rlike(r"^(?:10|127|172|192)\."), yes).otherwise(nothing),
            "email": F.when(F.lower(value).rlike(r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"), yes).otherwise(nothing),
        }[kind]
    words = F.when(near.rlike(WORDS_FOR[kind]), yes).when(near.rlike(WORDS_AGAINST), no).otherwise(nothing)
    touches = m["before"].rlike("[A-Za-z0-9]$") | m["after"].rlike("[A-Za-z0-9]")
    edges = F.when(touches, no).otherwise(yes)
    return [strict, shape, words, ending, edges]


SPAN = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,size:int>>"


def _candidates(
    kind: str, pattern: str, text: Column, base: bool, taken: Column | None = None, digits: tuple[int, int] | None = None
) -> Column:
    found = matches(text, pattern, NEEDED.get(kind) if base else None)
    if base and kind != "email":
        found = F.filter(found, lambda m: _valid(kind, m["value"]))
    if digits:
        found = F.filter(found, lambda m: F.length(_digits(m["value"])).between(*digits))
    if taken is not None:  # what a base or earlier span covers is no candidate
        found = F.filter(
            found, lambda m: ~F.exists(taken, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        )
    size = lambda m: F.least(F.floor(F.length(m["value"]) / 8), F.lit(4)).cast("int")
    spans = F.transform(
        found,
        lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(base).alias("base"),
            F.array(*_votes(kind, m, base)).alias("votes"),
            size(m).alias("size"),
        ),
    )
    return spans.cast(SPAN)


def candidates(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with its candidate spans in ``_spans``."""
    base = docs.withColumns({f"_{k}": _candidates(k, p, text, True) for k, p in BASE.items()})
    every = F.concat(*[F.col(f"_{k}") for k in BASE])
    loose = base.withColumn("_base", every)
    own: dict[str, list[str]] = {}
    for i, (kind, pattern, digits) in enumerate(LOOSE):
        taken = F.concat("_base", *[F.col(c) for c in own.get(kind, [])])
        loose = loose.withColumn(f"_loose_{i}", _candidates(kind, pattern, text, False, taken, digits))
        own.setdefault(kind, []).append(f"_loose_{i}")
    added = [f"_loose_{i}" for i in range(len(LOOSE))]
    spans = F.array_sort(F.concat("_base", *added))
    return loose.withColumn("_spans", spans).drop("_base", *[f"_{k}" for k in BASE], *added)


def _estimate(kind: np.ndarray, votes: np.ndarray, known: np.ndarray, n: np.ndarray, steps: int = 60) -> np.ndarray:
    """Probability that the spans of each combination are true, by expectation-maximisation.

    Given the truth, labelers vote independently; each has its own chances of yes, no and
    nothing. Known spans stay true. One count is added to every cell.
    """
    share = np.clip(((votes == 1).sum(axis=1) + 0.5) / ((votes >= 0).sum(axis=1) + 1), 0.05, 0.95)
    share = np.where(known, 1.0, share)
    for _ in range(steps):
        logs = np.zeros((2, len(n)))
        for y, weight in enumerate((n * (1 - share), n * share)):
            for k in range(len(KINDS)):
                here = kind == k
                total = weight[here].sum()
                logs[y, here] += np.log((total + 1) / (n[here].sum() + 2)) if here.any() else 0
            for j in range(votes.shape[1]):
                cells = np.array([weight[votes[:, j] == v].sum() + 1 for v in (-1, 0, 1)])
                logs[y] += np.log(cells / cells.sum())[votes[:, j] + 1]
        share = np.where(known, 1.0, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))
    return share


def _inputs(kind: np.ndarray, votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(kind))]
    columns += [kind == k for k in range(len(KINDS))]
    columns += [votes[:, j] == v for j in range(votes.shape[1]) for v in (0, 1)]
    columns += [size == s for s in range(5)]
    return np.stack(columns, axis=1).astype(float)


def _classifier(x: np.ndarray, share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the estimated probabilities, by Newton steps with a ridge."""
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (share - p)) - weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        weights = weights + np.linalg.solve(curve, slope)
    return weights


def _chance(span: Column, weights: np.ndarray) -> Column:
    """Log odds of a span under the classifier."""
    at, total = 1, F.lit(float(weights[0]))
    for k in range(len(KINDS)):
        total = total + F.when(span["kind"] == k, float(weights[at + k])).otherwise(0.0)
    at += len(KINDS)
    for j in range(len(LABELERS)):
        vote = F.get(span["votes"], F.lit(j))
        total = total + F.when(vote == 0, float(weights[at])).when(vote == 1, float(weights[at + 1])).otherwise(0.0)
        at += 2
    for s in range(5):
        total = total + F.when(span["size"] == s, float(weights[at + s])).otherwise(0.0)
    return total


def find_personal_data(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``spans``: ``array<struct<kind, start, end, base>>``.

    Spans are in code points, end exclusive, ordered by kind as in ``KINDS``, then start.
    Base matches are leftmost and do not overlap within a kind; those that fail their
    check are dropped. A null or empty text has no spans; texts of any length are read whole;
    rows are independent of each other but for the estimated reliabilities; other columns
    are not read; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))
    found = written(candidates(own, text).drop("_text"))
    counted = (
        found.select(F.explode("_spans").alias("s"))
        .groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.base").alias("base"), F.col("s.size").alias("size"))
        .agg(F.count("*").alias("n"))
        .collect()  # at most one row per combination of kind, votes, origin and length class
    )
    accepted = F.lit(False)
    if counted:
        counted.sort(key=lambda r: (r.kind, r.votes, r.base, r["size"]))
        kind, size, n = (np.array([r[c] for r in counted]) for c in ("kind", "size", "n"))
        votes, known = np.array([r.votes for r in counted]), np.array([r.base for r in counted])
        share = _estimate(kind, votes, known, n.astype(float))
        weights = np.round(_classifier(_inputs(kind, votes, size), share, n.astype(float)), 6)
        kept = F.filter("_spans", lambda s: s["base"] | (_chance(s, weights) >= 0))
    else:
        kept = F.filter("_spans", lambda s: s["base"] | accepted)
    fields = lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "base")])
    return found.select(*[F.col(f"`{c}`") for c in keep], F.transform(kept, fields).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal_data(docs, "text", ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def number(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint")

    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_personal_data": op7_personal_data}
