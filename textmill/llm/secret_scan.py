"""Secrets by one deterministic automaton for all rules.

The rules are regular expressions. On the driver they are compiled together, by subset
construction and minimisation, into one transition array that searches for all of them at
once; it and the small automata of the single rules travel with the tasks. A task scans
the bytes of its texts once: bytes that no rule uses cut texts into stretches, which
advance through the array side by side, and every stretch tells which rules end in it.

Only stretches with a hit are looked at again, rule by rule: an automaton reading
backwards marks where a match can begin, the one reading forwards gives the longest match
from the first mark, and the search goes on behind it. So spans are the leftmost matches
that do not overlap, per kind, in time that follows the length of the stretch.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm import sql
from textmill.llm.automaton import Automaton, compiled
from textmill.llm.shared import ship
from textmill.llm.words import pieces

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


class Rule(NamedTuple):
    """A match is ``head`` and then ``value``; it counts if its value has ``least`` characters.

    ``needs`` is an expression that occurs in every match that counts. The shared automaton
    looks for it, so it should be rare in texts and end as early as it can: what goes on
    after the end multiplies the states of all rules.
    """

    kind: str
    head: str
    value: str
    least: int
    needs: str


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The three kinds every scan has, as they are defined for it.
ASSIGN = _either_case("(password|passwd|secret|token|api_?key)") + r"[\"']?\x20*[:=]\x20*[\"']?"
BASE = (
    Rule("assign", ASSIGN, "[A-Za-z0-9+/_.=-]+", 6, ASSIGN + "[A-Za-z0-9+/_.=-]"),
    Rule("access", "AKIA", "[A-Z0-9]+", 16, "AKIA[A-Z0-9]"),
    Rule("hex", "", "[0-9a-f]+", 24, "[0-9a-f]{24}"),
)
# Published forms of credentials.
FURTHER = (
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 16, "eyJ[A-Za-z0-9_-]"),
    Rule("hosting", "(gh[pousr]_|glpat-)", "[A-Za-z0-9_-]+", 20, "(gh[pousr]_|glpat-)[A-Za-z0-9_-]"),
    Rule("chat", "xox[abeprs]-", "[A-Za-z0-9-]+", 20, "xox[abeprs]-[A-Za-z0-9-]"),
    Rule("cloud", "AIza", "[A-Za-z0-9_-]+", 35, "AIza[A-Za-z0-9_-]"),
    Rule("payment", "[rs]k_(live|test)_", "[A-Za-z0-9]+", 16, "[rs]k_(live|test)_[A-Za-z0-9]"),
    Rule("private", "-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY", "-----", 5, "PRIVATE KEY-----"),
    Rule(
        "login",
        "(https?|ftp|amqps?|mongodb|mysql|postgres|postgresql|redis)://[A-Za-z0-9._%-]+:",
        "[A-Za-z0-9._~!$%&*+=-]+@",
        5,
        "://[A-Za-z0-9._%-]+:",
    ),
)
RULES = BASE + FURTHER


class _Exact:
    """Leftmost matches of one rule that do not overlap, in a stretch of bytes."""

    def __init__(self, rule: Rule) -> None:
        whole = rule.head + rule.value
        self.rule = rule
        back = compiled([whole], search=True, backward=True)
        self.used = back.used
        self.back = self._steps(back)
        self.ahead = self._steps(compiled([whole]))
        self.head = self._steps(compiled([rule.head]))

    @staticmethod
    def _steps(found: Automaton) -> tuple[list[list[int]], list[bool], int]:
        """Transitions, ends, and the state from which nothing ends (-1 if there is none)."""
        stuck = (found.moves == np.arange(len(found.moves))[:, None]).all(axis=1) & (found.accept == 0)
        return found.rows, (found.accept > 0).tolist(), int(np.flatnonzero(stuck)[0]) if stuck.any() else -1

    @staticmethod
    def _longest(steps, data: bytes, start: int, limit: int) -> int:
        rows, ends, stuck = steps
        state, last = 0, start if ends[0] else -1
        for at in range(start, limit):
            state = rows[state][data[at]]
            if state == stuck:
                break
            if ends[state]:
                last = at + 1
        return last

    def spans(self, data: bytes) -> list[tuple[int, int]]:
        rows, ends, _ = self.back
        state, begins = 0, []
        for at in range(len(data) - 1, -1, -1):
            state = rows[state][data[at]]
            if ends[state]:
                begins.append(at)
        found, free = [], 0
        for start in reversed(begins):
            if start < free:
                continue
            free = self._longest(self.ahead, data, start, len(data))
            if free - self._longest(self.head, data, start, free) >= self.rule.least:
                found.append((start, free))
        return found


class Scanner:
    """All rules, compiled."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.kinds = [r.kind for r in rules]
        self.shared = compiled([r.needs for r in rules], search=True)
        self.exact = [_Exact(r) for r in rules]
        self.used = self.shared.used | np.any([e.used for e in self.exact], axis=0)

    def _stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of bytes that rules use; none crosses the border of a text."""
        inside = self.used[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[first] = inside[first]
        starts = np.flatnonzero(begin)
        stops = np.flatnonzero(~inside)
        borders = np.union1d(stops, offsets[1:])
        return starts, borders[np.searchsorted(borders, starts, side="right")]

    def scan(self, texts: pa.Array) -> pa.Array:
        """Spans of each text, by start and then kind, in code points."""
        found: list[tuple[int, int, int, int]] = []
        for low, _, data, offsets in pieces(texts):
            starts, ends = self._stretches(data, offsets)
            if not len(starts):
                continue
            bits = self.shared.found(data, starts, ends)
            hit = np.flatnonzero(bits)
            if not len(hit):
                continue
            owner = np.searchsorted(offsets, starts[hit], side="right") - 1
            letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            for i, text in zip(hit.tolist(), owner.tolist(), strict=True):
                part = data[starts[i] : ends[i]].tobytes()
                before = int(letters[starts[i]] - letters[offsets[text]])  # what rules use is ASCII
                for k, exact in enumerate(self.exact):
                    if int(bits[i]) >> k & 1:
                        found += [(low + text, before + a, k, before + b) for a, b in exact.spans(part)]
        found.sort()
        rows = np.array([f[0] for f in found], np.int64)
        ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(texts))))).astype(np.int32)
        span = pa.StructArray.from_arrays(
            [
                pa.array([self.kinds[f[2]] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([f[3] for f in found], pa.int64()),
            ],
            ["kind", "start", "end"],
        )
        return pa.ListArray.from_arrays(pa.array(ends), span)


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The secrets of a text: ``array<struct<kind, start, end>>``, by start, then in the order of the rules.

    Starts and ends count code points, ends exclusive. A null or empty text has none. A text
    is scanned whole, whatever its length; rows do not depend on each other.
    """
    ship()
    scanner = Scanner(tuple(rules))

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        return scanner.scan(texts)

    return scan(text)


def find_secrets(docs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """``docs`` with :func:`secret_spans` of its text as a column; a column of that name is replaced.

    Other columns pass through, repeated rows are scanned alike, an empty table gives an
    empty one.
    """
    return docs.withColumn(name, secret_spans(F.col(f"`{text_col}`"), rules))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents by the base kinds and the published forms."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, "text").select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


QUERIES = {"op11_secret_scan": op11_secret_scan}
ORACLE = {
    "op11_secret_scan": sql.secrets(
        [
            (
                "assign",
                r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
                r"""length(regexp_extract(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6""",
            ),
            ("access", "AKIA[A-Z0-9]{16,}", "true"),
            ("hex", "[0-9a-f]{24,}", "true"),
        ],
        [
            (
                r.kind,
                (r.head + r.value).replace("(", "(?:"),
                f"length(hit) - length(regexp_extract(hit, '^(?:{r.head.replace('(', '(?:')})')) >= {r.least}",
            )
            for r in FURTHER
        ],
    )
}
