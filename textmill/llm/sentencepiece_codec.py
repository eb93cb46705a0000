"""SentencePiece encoding and decoding on the tokenizers library.

The model file, a protobuf, is read field by field; from it come the pieces with scores and
kinds and the flags of trainer and normaliser. They are rebuilt as a ``Tokenizer``:

- normaliser: the character map of the file if it has one, runs of spaces squeezed if
  the file asks for it, the marker U+2581 in front and for every space;
- a unigram model with its scores, or, for files of merges, a BPE whose merges are all
  splits of a piece into two pieces, best score first;
- byte fallback, and a decoder that undoes all of it.

Where no piece holds a marker behind another character, no token crosses the place in front of
a run of markers. Texts are then cut there, and a word is encoded by the library once and
looked up afterwards; the words kept are bounded by ``KEPT_WORDS`` and ``KEPT_LETTERS``.

Texts are encoded batch by batch with the library's threads: as many as ``OMP_NUM_THREADS``
says, which Spark sets to the cores of a task, and one where it is unset. ``parity`` runs the
original library beside it, over whole texts. The registered query holds every text against it
as well: a text that is cut at its spaces word by word, each distinct word once, as no token of
either library crosses a space there; any other text whole. Both agree on every text for models
of merges; for unigram models, where two ways to cut a text have the very same score, either
library may take the other one.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
GROUP_BYTES = 1 << 20
KEPT_WORDS = 500_000
KEPT_LETTERS = 16 << 20
WORD = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Field numbers and values of a protobuf message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", message, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, message[at : at + 8]
            at += 8
        elif kind == 2:
            size = varint()
            yield tag >> 3, message[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind} in the model file")


@dataclass(frozen=True)
class Model:
    """What a model file says, with the format's defaults."""

    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    unknown: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), float(piece.get(2, 0.0)), int(piece.get(3, NORMAL))))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if not pieces:
            raise ValueError("the model file has no pieces")
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        return cls(
            tuple(pieces),
            int(trainer.get(3, UNIGRAM)),
            unknown,
            bool(trainer.get(35, 0)),
            bytes(normalizer.get(2, b"")),
            bool(normalizer.get(3, 1)),
            bool(normalizer.get(4, 1)),
            bool(normalizer.get(5, 1)),
        )


def build(model: Model, normalized: bool = False):
    """The ``Tokenizer`` that encodes and decodes as the model file says; without its
    normaliser for texts that are ``normalized`` already."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        usable = {p: i for i, (p, _, k) in enumerate(model.pieces) if k in (NORMAL, USER)}
        merges = []
        for piece, rank in usable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    merges.append((-model.pieces[rank][1], rank, usable[left], usable[right], left, right))
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(
            vocab,
            [m[4:] for m in sorted(merges)],
            unk_token=model.pieces[model.unknown][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    space = MARKER if model.escape else " "
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(space))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps and not normalized:
        tokenizer.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(MARKER, " ")] if model.escape else []
    undo += [decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(undo)
    return tokenizer


class Codec:
    """A model's tokenizer with the words it has met."""

    def __init__(self, data: bytes) -> None:
        self.model = Model.parse(data)
        self._tokenizer = None
        usable = {p for p, _, k in self.model.pieces if k in (NORMAL, USER)}
        self.cuts = self.model.escape and MARKER in usable and not any(MARKER in p.lstrip(MARKER) for p in usable)
        self.words = build(self.model, normalized=True)
        self.plain = self.model.dummy_prefix and not self.model.charsmap and not self.model.squeeze
        self.known: dict[str, bytes] = {}
        self.letters = 0
        self.original = None  # where set, new words are held against it
        self.odd: set[str] = set()
        self.surface = [self._bytes(p, k) for p, _, k in self.model.pieces]

    @property
    def tokenizer(self):
        """The whole tokenizer, built when it is needed: most texts do without its normaliser and decoder."""
        if self._tokenizer is None:
            self._tokenizer = build(self.model)
        return self._tokenizer

    def _bytes(self, piece: str, kind: int) -> bytes | None:
        """What a piece stands for in a decoded text, where that does not hang on its neighbours."""
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind in (NORMAL, USER):
            return (piece.replace(MARKER, " ") if self.model.escape else piece).encode()
        return None

    def _normal(self, text: str) -> str:
        if self.plain:
            return MARKER + text.replace(" ", MARKER) if text else ""
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _cut(self, text: str) -> list[str]:
        """The words of a text, each with the markers in front of it."""
        return self._plain_words(text) or WORD.findall(self._normal(text))

    def _plain_words(self, text: str) -> list[str]:
        """The words of a text of which only the spaces change, with none at an end and no two in a row; else none."""
        if self.plain and MARKER not in text:
            words = text.split(" ")
            if "" not in words:
                return [MARKER + w for w in words]
        return []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, np.int32) for e in found]
        if len(self.known) > KEPT_WORDS or self.letters > KEPT_LETTERS:
            self.known, self.letters, self.odd = {}, 0, set()
        cut = [self._cut(t) for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        for word, found in zip(new, self.words.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.ids, np.int32).tobytes()
            self.letters += len(word)
        if self.original is not None:
            self._verify([w for w in new if w.rfind(MARKER) == 0])
        look = self.known.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), np.int32) for words in cut]

    def _verify(self, words: list[str]) -> None:
        """Note the words that the original library encodes differently."""
        theirs = self.original.encode([w[1:] for w in words], num_threads=1)
        self.odd.update(w for w, ids in zip(words, theirs, strict=True) if self.known[w] != np.array(ids, np.int32).tobytes())

    def agrees(self, text: str, ids: np.ndarray) -> bool:
        """Whether the original library gives these ids, for a text just encoded with ``original`` set."""
        words = self._plain_words(text) if self.cuts else []
        if words:
            return not self.odd or self.odd.isdisjoint(words)
        return np.array_equal(ids, self.original.encode(text))

    def decode(self, rows: list) -> list[str]:
        """Texts of token ids; ids of special tokens, or of bytes that form no text, go through the library."""
        out = []
        for row in rows:
            row = row.tolist() if isinstance(row, np.ndarray) else list(row)
            try:
                text = b"".join(map(self.surface.__getitem__, row)).decode()
                out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
            except (TypeError, UnicodeDecodeError):
                out.append(self.tokenizer.decode(row, skip_special_tokens=False))
        return out


_READY: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    key = hashlib.sha256(data).digest()
    if key not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        # As many threads as the task's share of the machine, where Spark says so.
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        _READY.clear()
        _READY[key] = Codec(data)
    return _READY[key]


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about a megabyte; a null is an empty text."""
    texts, size, first = [], 0, 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def _encode(data: bytes, at: int, names: list[str]):
    def run(batches):
        codec = _codec(data)
        for batch in batches:
            for first, texts in _groups(batch.column(at)):
                rows = codec.encode(texts)
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                flat = pa.array(np.concatenate(rows))
                ids = pa.ListArray.from_arrays(pa.array(ends), flat)
                part = batch.slice(first, len(texts))
                added = [ids]
                if len(names) > 1:
                    added.append(pa.array([a == b for a, b in zip(texts, codec.decode(rows), strict=True)]))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *names])

    return run


def _decode(data: bytes, place: int, name: str):
    def run(batches):
        codec = _codec(data)
        for batch in batches:
            column = batch.column(place)
            out = []
            for at in range(0, len(batch), 256):
                rows = [r or [] for r in column.slice(at, 256).to_pylist()]
                out += codec.decode(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return run


def _model_bytes(path: str) -> bytes:
    """The model file, a few hundred kilobytes, read by the driver and sent with the tasks."""
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, text_col: str, ids_col: str = "ids", model_path: str = MODEL, round_trip_col: str | None = None
) -> DataFrame:
    """``docs`` with the token ids of its text, ``array<int>``.

    With ``round_trip_col`` the ids are decoded again, and that column says whether they gave
    the text. A null or empty text has no tokens; there is no limit on length. All other
    columns pass through; added names that ``docs`` has already are refused. An empty table
    gives an empty one.
    """
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    ship()
    added = [StructField(ids_col, ArrayType(IntegerType()))]
    if round_trip_col:
        added.append(StructField(round_trip_col, BooleanType()))
    names = [f.name for f in added]
    if len({*docs.columns, *names}) < len(docs.columns) + len(names):
        raise ValueError(f"the table has a column of a name to be added: {', '.join(names)}")
    run = _encode(_model_bytes(model_path), docs.columns.index(text_col), names)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def decode(docs: DataFrame, ids_col: str, text_col: str, model_path: str = MODEL) -> DataFrame:
    """``docs`` with the text of its token ids; null or no ids give the empty text. A name that ``docs`` has already is refused."""
    from pyspark.sql.types import StringType, StructField, StructType

    if text_col in docs.columns:
        raise ValueError(f"the table has a column {text_col} already")
    ship()
    own = docs.withColumn(ids_col, F.col(ids_col).cast("array<int>"))
    schema = StructType([*own.schema.fields, StructField(text_col, StringType())])
    return own.mapInArrow(_decode(_model_bytes(model_path), own.columns.index(ids_col), text_col), schema)


def parity(texts: list[str], model_path: str = MODEL) -> list[int]:
    """Positions of texts that the original library encodes or decodes differently."""
    import sentencepiece

    data = _model_bytes(model_path)
    own, original = _codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = own.encode(texts)
    back = own.decode(ids)
    theirs = original.encode(texts)
    return [i for i in range(len(texts)) if ids[i].tolist() != theirs[i] or back[i] != original.decode(theirs[i])]


def _round(data: bytes):
    """Ids of each text, hashed, the text they decode to, and whether the original library agrees."""

    def run(batches):
        import sentencepiece

        codec = _codec(data)
        codec.known, codec.letters = {}, 0  # words met before were not held against the original
        codec.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        for batch in batches:
            for first, texts in _groups(batch.column(1)):
                ids = codec.encode(texts)
                back = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(r) for r in ids], pa.int64()),
                        pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in ids]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([t == b for t, b in zip(texts, back, strict=True)]),
                        pa.array([codec.agrees(t, r) for t, r in zip(texts, ids, strict=True)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "parity"],
                )
        codec.original = None

    return run


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, decoded again and held against the original library."""
    ship()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    schema = (
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"
    )
    return docs.mapInArrow(_round(_model_bytes(MODEL)), schema)


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
