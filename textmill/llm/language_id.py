"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language; the text gets the language of most of it, so that
code-switched texts are measured word by word. A word's score per language sums the
weights of its features: the word, its prefixes and suffixes, its letter bigrams and
trigrams (hashed), and a lexicon value, the log share of each language among all
occurrences of the word (hashed) in all training texts. Neighbouring words are tied by
learned transitions; forward-backward gives each word's probabilities.

The lexicon counts every labelled training text, in one aggregation. Weights and
transitions are fitted by gradient steps on the likelihood of a sample of about
``SAMPLE`` whole training texts per language, picked by a hash of their id; they are chained
one after another, so that changes of language occur in training too. Chains are cut every
``CHAIN`` words, and forward-backward runs over ``BLOCK_CHAINS`` of them at once, which bounds
memory beside the sample's own words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from textmill.llm.shared import ship
from textmill.llm.words import BASE, U64, mix

SAMPLE = 400
CHAIN = 64
BLOCK_CHAINS = 2048
FEATURES = 1 << 15
LEXICON = 1 << 14
STEPS = 30
GROUP_WORDS = 200_000
KEPT_WORDS = 400_000
KEPT_LETTERS = 16 << 20
FOLD, FOLDS = 2, 4
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each between marks, their word, place in it, and the words' sizes."""
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    sizes = np.array([len(w) for w in words]) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    return codes, owner, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def _whole(codes: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each word."""
    power = np.full(int(sizes.max(initial=1)), BASE, U64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    return mix(np.add.reduceat(codes * power[place], np.cumsum(sizes) - sizes))


def buckets(words: list[str]) -> np.ndarray:
    """Place of each word in the lexicon."""
    if not words:
        return np.zeros(0, np.int64)
    codes, _, place, sizes = _hashed(words)
    return (_whole(codes, place, sizes) % U64(LEXICON)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words and the word each belongs to: word, affixes, letter bigrams and trigrams."""
    codes, owner, place, sizes = _hashed(words)
    end = np.cumsum(sizes)
    value, of = [mix(_whole(codes, place, sizes) + U64(1))], [np.arange(len(words))]

    def add(kind: int, at: np.ndarray, n: int, who: np.ndarray) -> None:
        total = np.full(len(at), kind * 7919 + n, U64)
        for j in range(n):
            total += codes[at + j] * U64(pow(BASE, 2 * j + 1, 1 << 64))
        value.append(mix(total))
        of.append(who)

    for n in (1, 2, 3):
        own = np.flatnonzero(sizes >= n + 2)
        add(2, end[own] - sizes[own] + 1, n, own)
    for n in (1, 2, 3, 4):
        own = np.flatnonzero(sizes >= n + 2)
        add(3, end[own] - 1 - n, n, own)
    for n in (2, 3):
        at = np.flatnonzero(place <= (sizes[owner] - n))
        add(4, at, n, owner[at])
    owner = np.concatenate(of)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(value)[order] % U64(FEATURES)).astype(np.int64), owner[order]


@dataclass
class Chain:
    """The fitted model."""

    labels: list[str]
    weights: np.ndarray  # FEATURES x labels
    lexicon: np.ndarray  # LEXICON x labels, log shares
    trust: float  # weight of the lexicon
    moves: np.ndarray  # labels x labels
    start: np.ndarray
    common: np.ndarray  # LEXICON x labels, log of how often a bucket's words occur against an even spread


class Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _sparse(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words, the word each belongs to, and lexicon buckets."""
    return (*features(words), buckets(words))


def _scores(model: Chain, flat: np.ndarray, owner: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    out = model.trust * model.lexicon[buckets]
    for y in range(len(model.labels)):
        out[:, y] += np.bincount(owner, model.weights[flat, y], len(buckets))
    return out


def forward_backward(score: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """Marginals per chain and place, expected transitions, and the log likelihood's normalizer.

    ``score`` is chains x places x labels; places beyond a chain's length are ignored.
    """
    chains, places, labels = score.shape
    top = score.max(axis=2, keepdims=True)
    local = np.exp(score - top)
    live = np.arange(places)[None, :] < lengths[:, None]
    step = np.exp(moves)
    alpha = np.empty_like(local)
    log_z = np.where(live, top[:, :, 0], 0).sum(axis=1)
    for t in range(places):
        now = (np.exp(start)[None, :] if t == 0 else alpha[:, t - 1] @ step) * local[:, t]
        total = now.sum(axis=1, keepdims=True)
        alpha[:, t] = now / total
        log_z += np.where(live[:, t], np.log(total[:, 0]), 0)
    beta = np.ones((chains, labels))
    marginal = np.zeros_like(local)
    pairs = np.zeros((labels, labels))
    for t in range(places - 1, -1, -1):
        both = alpha[:, t] * beta
        marginal[:, t] = both / both.sum(axis=1, keepdims=True) * live[:, t][:, None]
        if t:
            ahead = local[:, t] * beta
            joint = alpha[:, t - 1][:, :, None] * step[None] * ahead[:, None, :]
            joint *= (live[:, t] / joint.sum(axis=(1, 2)))[:, None, None]
            pairs += joint.sum(axis=0)
            before = ahead @ step.T
            before /= before.sum(axis=1, keepdims=True)
            beta = np.where(live[:, t][:, None], before, 1.0)
    return marginal, pairs, log_z


def _chained(numbers: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains over a run of words cut at ``breaks`` and every CHAIN words.

    Returns for each word its chain and place, and the lengths of the chains.
    """
    begin = np.zeros(len(numbers), np.int64)
    begin[breaks] = breaks
    begin = np.maximum.accumulate(begin)
    place = (np.arange(len(numbers)) - begin) % CHAIN
    chain = np.cumsum(place == 0) - 1
    return chain, place, np.bincount(chain)


def _numbered(texts: Iterable[list[str]], tags: list[int]) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The words of all texts by number, and the label of each; texts may come from a generator and are not kept."""
    known = Vocabulary()
    numbers, sizes = [np.zeros(0, np.int32)], []
    for words in texts:
        numbers.append(np.array([known[w] for w in words], np.int32))
        sizes.append(len(words))
    return known, np.concatenate(numbers), np.repeat(np.array(tags, np.int16), sizes)


def _expected(model: Chain, emission: np.ndarray, numbers: np.ndarray, gold: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """What the labels have over what the model expects: by word and label, by transition, by first label.

    The run of words is cut into chains of CHAIN words; a block of chains is worked on at a
    time, so that memory follows the block and not the sample.
    """
    labels = len(model.labels)
    by_word = np.zeros(words * labels)
    pairs, first = np.zeros((labels, labels)), np.zeros(labels)
    for low in range(0, len(numbers), BLOCK_CHAINS * CHAIN):
        own, tag = numbers[low : low + BLOCK_CHAINS * CHAIN], gold[low : low + BLOCK_CHAINS * CHAIN]
        chain, place, lengths = _chained(own, np.array([0]))
        score = np.zeros((len(lengths), int(lengths.max()), labels))
        score[chain, place] = emission[own]
        marginal, expected, _ = forward_backward(score, lengths, model.moves, model.start)
        off = -marginal[chain, place]
        off[np.arange(len(own)), tag] += 1
        cells = (own.astype(np.int64)[:, None] * labels + np.arange(labels)).reshape(-1)
        by_word += np.bincount(cells, off.reshape(-1), words * labels)
        same = chain[1:] == chain[:-1]
        pairs += np.bincount(tag[:-1][same].astype(np.int64) * labels + tag[1:][same], minlength=labels * labels).reshape(labels, labels)
        pairs -= expected
        first += off[place == 0].sum(axis=0)
    return by_word.reshape(words, labels), pairs, first


def fit(texts: Iterable[list[str]], tags: list[int], labels: list[str], lexicon: np.ndarray, common: np.ndarray) -> Chain:
    """Fit weights and transitions to texts of one language each, chained in their order."""
    model = Chain(
        labels, np.zeros((FEATURES, len(labels))), lexicon, 0.1, np.zeros((len(labels),) * 2), np.zeros(len(labels)), common
    )
    known, numbers, gold = _numbered(texts, tags)
    if not len(numbers) or len(labels) < 2:
        return model
    flat, owner, buckets = _sparse(list(known))
    size, total = len(known), len(numbers)
    del known
    squares = [np.full_like(x, 1e-8) for x in (model.weights, model.moves, model.start)]
    trust_square = 1e-8
    for _ in range(STEPS):
        emission = _scores(model, flat, owner, buckets)
        by_word, pairs, first = _expected(model, emission, numbers, gold, size)
        slope = np.stack(
            [np.bincount(flat, by_word[owner, y], FEATURES) for y in range(len(labels))], axis=1
        ) / total - 1e-7 * model.weights
        trust = float((by_word * lexicon[buckets]).sum()) / total
        slopes = (slope, pairs / total - 1e-5 * model.moves, first / total)
        for value, by, square, rate in zip(
            (model.weights, model.moves, model.start), slopes, squares, (0.2, 0.5, 0.2), strict=True
        ):
            square += by * by
            value += rate * by / np.sqrt(square)
        trust_square += trust * trust
        model.trust += 0.05 * trust / np.sqrt(trust_square)
    return model


class Tagger:
    """Labels texts with a fitted model; keeps the scores of words it has seen."""

    def __init__(self, model: Chain) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known, self.letters = Vocabulary(), 0
        self.scores, self.common = np.zeros((2, 0, len(self.model.labels)))

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS or self.letters > KEPT_LETTERS:
            self._forget()
        known = self.known
        numbers = np.array([known[w] for w in words], np.int64)
        if len(known) > len(self.scores):
            new = list(known)[len(self.scores) :]
            self.letters += sum(map(len, new))
            flat, owner, places = _sparse(new)
            self.scores = np.concatenate([self.scores, _scores(self.model, flat, owner, places)])
            self.common = np.concatenate([self.common, self.model.common[places]])
        return numbers

    def shares(self, texts: list[list[str]]) -> np.ndarray:
        """Share of each language in each text, 0 where a text has no words."""
        return self._judged(texts)[0]

    def _judged(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages, and how common the words are on average in each."""
        sizes = np.array([len(t) for t in texts])
        out, common = np.zeros((2, len(texts), len(self.model.labels)))
        flat = [w for t in texts for w in t]
        if not flat or not self.model.labels:
            return out, common
        owner = np.repeat(np.arange(len(texts)), sizes)
        numbers = self._numbers(flat)
        breaks = (np.cumsum(sizes) - sizes)[sizes > 0]
        chain, place, lengths = _chained(numbers, breaks)
        score = np.zeros((len(lengths), int(lengths.max()), len(self.model.labels)))
        score[chain, place] = self.scores[numbers]
        marginal, _, _ = forward_backward(score, lengths, self.model.moves, self.model.start)
        each = marginal[chain, place]
        for y in range(out.shape[1]):
            out[:, y] = np.bincount(owner, each[:, y], len(texts))
            common[:, y] = np.bincount(owner, self.common[numbers, y], len(texts))
        words = np.maximum(sizes, 1)[:, None]
        return out / words, common / words

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its share and how common the words are; ``und`` and zeros for a text without letters."""
        names, scores, familiar, group, size = [], [], [], [], 0

        def flush() -> None:
            for words, share, common in zip(group, *self._judged(group), strict=True):
                best = int(share.argmax()) if len(share) else 0
                known = bool(words) and len(share) > 0
                names.append(self.model.labels[best] if known else UNKNOWN)
                scores.append(float(min(1.0, max(0.0, share[best]))) if known else 0.0)
                familiar.append(float(common[best]) if known else 0.0)
            group.clear()

        for text in texts:
            group.append(words_of(text))
            size += len(group[-1])
            if size >= GROUP_WORDS:
                flush()
                size = 0
        flush()
        return names, scores, familiar


def _counted(labels: list[str]):
    """Occurrences of hashed words per language, summed within the task."""
    at = {label: y for y, label in enumerate(labels)}

    def run(batches):
        counts = np.zeros((LEXICON, len(labels)), np.int64)
        for batch in batches:
            group, tags, size = [], [], 0
            for i in range(len(batch)):
                group.append(words_of(batch.column(0)[i].as_py()))
                tags.append(at[batch.column(1)[i].as_py()])
                size += len(group[-1])
                if size >= GROUP_WORDS or i == len(batch) - 1:
                    known = Vocabulary()
                    numbers = np.array([known[w] for words in group for w in words], np.int64)
                    label = np.repeat(np.array(tags, np.int64), [len(words) for words in group])
                    if len(known):
                        each = np.bincount(numbers * len(labels) + label, minlength=len(known) * len(labels))
                        np.add.at(counts, buckets(list(known)), each.reshape(len(known), len(labels)))
                    group, tags, size = [], [], 0
        b, y = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(counts[b, y])], ["b", "y", "n"]
        )

    return run


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Chain:
    """Learn from all rows of ``docs`` with a text and a language.

    To the driver come the distinct languages, the lexicon (``LEXICON`` buckets per language)
    and about ``sample`` texts per language.
    """
    ship()
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    counts = np.zeros((LEXICON, len(labels)))
    for r in (
        rows.select("text", "lang").mapInArrow(_counted(labels), "b int, y int, n bigint").groupBy("b", "y").agg(F.sum("n").alias("n")).collect()
        if labels
        else []
    ):
        counts[r.b, r.y] = r["n"]
    rates = (counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * LEXICON)
    lexicon = np.log(rates / rates.sum(axis=1, keepdims=True)) if labels else counts
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = None
    for label in labels:
        share = F.col("lang") == label
        share = share & (spread < sample / sizes[label])
        chosen = share if chosen is None else chosen | share
    picked = rows.where(chosen).select("id", "text", "lang").toArrow().to_pylist() if labels else []
    # The last comes first, so that texts can be dropped from the end as they are numbered.
    picked.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"]), r["lang"], r["text"]), reverse=True)
    at = {label: y for y, label in enumerate(labels)}
    tags = [at[r["lang"]] for r in reversed(picked)]
    common = np.log(rates * LEXICON)
    return fit((words_of(picked.pop()["text"]) for _ in tags), tags, labels, lexicon, common)


def _tagged(parts, at_column: int, added: list[str]):
    def run(batches):
        tagger = Tagger(Chain(*parts.value))
        for batch in batches:
            names, scores, familiar = [], [], []
            column = batch.column(at_column)
            for at in range(0, len(batch), 512):
                n, s, f = tagger.label(column.slice(at, 512).to_pylist())
                names += n
                scores += s
                familiar += f
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(familiar, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made[: len(added)]], [*batch.schema.names, *added])

    return run


def identify(
    docs: DataFrame, model: Chain, text_col: str, lang_col: str = "lang_pred", score_col: str = "score", common_col: str | None = None
) -> DataFrame:
    """``docs`` with a language and a score (the share of the text in that language) added.

    With ``common_col`` there is a third column: the mean log, over the words, of how often words
    of their bucket of the lexicon occur in texts of that language, against an even spread.
    Texts of strings that no language has come out below zero. A null or empty text, or one
    without letters, is ``und`` with zeros; so is every text if no language was learned. Texts
    are read whole, rows are independent, other columns pass through, an empty table gives an
    empty one. Added names that ``docs`` has already are refused.
    """
    ship()
    added = [StructField(lang_col, StringType()), StructField(score_col, DoubleType())]
    added += [StructField(common_col, DoubleType())] if common_col else []
    names = [f.name for f in added]
    if len({*docs.columns, *names}) < len(docs.columns) + len(names):
        raise ValueError(f"the table has a column of a name to be added: {', '.join(names)}")
    parts = (model.labels, model.weights, model.lexicon, model.trust, model.moves, model.start, model.common)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    return docs.mapInArrow(_tagged(shared, docs.columns.index(text_col), names), StructType([*docs.schema.fields, *added]))


def held_out(id_col: str):
    """Rows that training never sees."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == FOLD


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id")), "doc_id", "text", "lang")
    done = identify(docs.select("doc_id", "text"), model, "text")
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
