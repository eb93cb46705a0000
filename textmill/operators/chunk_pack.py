"""Greedy sentence packing (C8-C11): text in, token-bounded chunks out.

The whole chunker is one Column expression over one row, so chunking a corpus is
a scan, a projection and a generate: no shuffle, no Python. Folds run over blocks of
pieces, so that no array grows step by step over a whole document and its work stays
in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.columns import let
from textmill.functions.sentences import sentence_pieces
from textmill.functions.text import strip
from textmill.functions.tokens import word_count, words

FOLD = 256  # Elements a fold gathers before it hands them on.
CHUNK_ARRAY = "array<struct<text:string,token_count:int,fresh_tokens:int>>"


def _budget_pieces(text: Column, budget: int) -> Column:
    """Sentences with their word counts; longer ones cut into windows of ``budget`` words."""

    def windows(piece: Column) -> Column:
        return let(
            words(piece),
            lambda w: F.transform(
                F.sequence(F.lit(0), F.size(w) - 1, F.lit(budget)),
                lambda i: F.struct(
                    F.concat(F.lit(" "), F.array_join(F.slice(w, i + 1, F.lit(budget)), " ")).alias("text"),
                    F.least(F.lit(budget), F.size(w) - i).alias("tok"),
                ),
            ),
        )

    def counted(piece: Column) -> Column:
        return let(
            F.struct(piece.alias("text"), word_count(piece).alias("tok")),
            lambda p: F.when(p["tok"] <= budget, F.array(p)).otherwise(windows(p["text"])),
        )

    return F.flatten(F.transform(sentence_pieces(text), counted))


def in_blocks(values: Column) -> Column:
    """An array cut into runs of ``FOLD`` elements."""
    count = F.ceil(F.size(values) / FOLD).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda b: F.slice(values, b * FOLD + 1, FOLD))
    return F.when(count > 0, runs).otherwise(F.slice(runs, 1, 0))


def _chunk_starts(pieces: Column, max_tokens: int, budget: int) -> Column:
    """Index of each chunk's first piece, then the piece count as a closing bound.

    Cuts are gathered per block of pieces, and the blocks' cuts once per block; only
    the running state goes from block to block.
    """
    none = F.array().cast("array<int>")
    start = F.struct(
        F.lit(0).alias("acc"), F.lit(0).alias("i"), F.lit(max_tokens).alias("cap"), F.array(F.array(F.lit(0))).alias("all")
    )

    def block(state: Column, toks: Column) -> Column:
        own = F.struct(*[state[c].alias(c) for c in ("acc", "i", "cap")], none.alias("cuts"))
        return let(
            F.aggregate(toks, own, step),
            lambda s: F.struct(*[s[c].alias(c) for c in ("acc", "i", "cap")], F.array_append(state["all"], s["cuts"]).alias("all")),
        )

    def step(a: Column, tok: Column) -> Column:
        return F.when(
            (a["acc"] > 0) & (a["acc"] + tok > a["cap"]),
            F.struct(
                tok.alias("acc"),
                (a["i"] + 1).alias("i"),
                F.lit(budget).alias("cap"),
                F.array_append(a["cuts"], a["i"]).alias("cuts"),
            ),
        ).otherwise(
            F.struct(
                (a["acc"] + tok).alias("acc"), (a["i"] + 1).alias("i"), a["cap"].alias("cap"), a["cuts"].alias("cuts")
            )
        )

    return F.aggregate(
        in_blocks(pieces["tok"]), start, block, lambda a: F.flatten(F.array_append(a["all"], F.array(a["i"])))
    )


def _fresh_parts(pieces: Column, cuts: Column) -> Column:
    """Text and word count of each chunk before overlap is added."""

    def part(i: Column) -> Column:
        return let(
            F.slice(pieces, cuts[i] + 1, cuts[i + 1] - cuts[i]),
            lambda run: F.struct(
                strip(F.array_join(run["text"], "")).alias("text"),
                F.aggregate(run["tok"], F.lit(0), lambda a, t: a + t).alias("tok"),
            ),
        )

    return F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), part)


def _with_overlap(parts: Column, overlap: int) -> Column:
    """Put the last ``overlap`` words of the chunk before in front."""

    def chunk(part: Column, i: Column) -> Column:
        if overlap == 0:
            return F.struct(part["text"].alias("text"), part["tok"].alias("token_count"), part["tok"].alias("fresh_tokens"))
        previous = parts[i - 1]
        carried = let(
            words(previous["text"]),
            lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - overlap + 1), F.lit(overlap)), " "),
        )
        return F.when(
            i > 0,
            F.struct(
                F.concat(carried, F.lit(" "), part["text"]).alias("text"),
                (part["tok"] + F.least(F.lit(overlap), previous["tok"])).alias("token_count"),
                part["tok"].alias("fresh_tokens"),
            ),
        ).otherwise(
            F.struct(part["text"].alias("text"), part["tok"].alias("token_count"), part["tok"].alias("fresh_tokens"))
        )

    return F.transform(parts, chunk)


def check_budget(max_tokens: int, overlap: int) -> None:
    if max_tokens < 1:
        raise ValueError(f"max_tokens must be at least 1, got {max_tokens}")
    if not 0 <= overlap < max_tokens:
        raise ValueError(f"overlap must be at least 0 and below max_tokens, got {overlap}")


def pack_text(text: Column, max_tokens: int = 512, overlap: int = 0) -> Column:
    """Chunks of one text as ``array<struct<text, token_count, fresh_tokens>>``.

    A text within ``max_tokens`` is one chunk and never reaches the sentence
    splitter (C11); a blank text has no chunk. The first chunk holds up to
    ``max_tokens`` words, later ones ``max_tokens - overlap`` of their own.
    """
    check_budget(max_tokens, overlap)
    budget = max_tokens - overlap

    def whole(t: Column, n: Column) -> Column:
        return F.array(F.struct(t.alias("text"), n.alias("token_count"), n.alias("fresh_tokens")))

    def packed(t: Column) -> Column:
        return let(
            _budget_pieces(t, budget),
            lambda pieces: let(
                _chunk_starts(pieces, max_tokens, budget),
                lambda cuts: let(_fresh_parts(pieces, cuts), lambda parts: _with_overlap(parts, overlap)),
            ),
        )

    return let(
        strip(text),
        lambda t: F.when((t == "") | t.isNull(), F.array().cast(CHUNK_ARRAY)).otherwise(
            let(word_count(t), lambda n: F.when(n <= max_tokens, whole(t, n)).otherwise(packed(t)))
        ),
    )
