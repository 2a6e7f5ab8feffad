"""Readers of model data: .npy vectors, .npz voices and SentencePiece vocabularies."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_npy_vector(data: bytes | str) -> np.ndarray:
    """A .npy file as a flat float32 vector."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    return np.load(source, allow_pickle=False).astype(np.float32).ravel()


def read_npz_voices(data: bytes | str) -> dict[str, np.ndarray]:
    """The two-dimensional float32 tables of a .npz file by name; a vector is a table of one row."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    with np.load(source, allow_pickle=False) as z:
        return {k: np.atleast_2d(z[k]).astype(np.float32) for k in z.files}


def voice_table(spark: SparkSession, voices: dict[str, np.ndarray]) -> DataFrame:
    """voice, row_idx, style: small, made to be joined by its two keys."""
    rows = [(k, i, row.tolist()) for k, t in sorted(voices.items()) for i, row in enumerate(t)]
    return spark.createDataFrame(rows, "voice string, row_idx int, style array<float>")


def style_rows(df: DataFrame, styles: DataFrame, length: Column, row: str = "row_idx", small: int = 100_000) -> DataFrame:
    """df with the row of a voice table styles(row, ...) that a length picks: at most the last one.

    A table of up to ``small`` rows is broadcast.  Of a larger one the last row, which all
    longer lengths share, is, and the others are joined by their number.
    """
    found = styles.agg(F.count(F.lit(1)).alias("n"), F.max(row).alias("last")).first()
    picked = df.withColumn(row, F.least(length.cast("long"), F.lit(found.last).cast("long")))
    if found.n <= small:
        return picked.join(F.broadcast(styles), row)
    top = picked.where(F.col(row) == found.last).join(F.broadcast(styles.where(F.col(row) == found.last)), row)
    return top.unionByName(picked.where(F.col(row) < found.last).join(styles, row))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


@dataclass
class SentencePieceModel:
    """pieces: (token, score, type) in the order of their ids; model_type: 1 unigram, 2 BPE, 3 word, 4 character."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = 1

    @property
    def is_char(self) -> bool:
        return self.model_type == 4

    @property
    def vocab(self) -> dict[str, int]:
        return {p[0]: i for i, p in enumerate(self.pieces)}

    @property
    def unknown(self) -> int:
        """The id of the piece of type 2, or else of <unk>, or 0."""
        return next((i for i, p in enumerate(self.pieces) if p[2] == 2), self.vocab.get("<unk>", 0))


def read_spm_model(data: bytes) -> SentencePieceModel:
    """Field 1 of the message are the pieces, field 2 the trainer's settings with the model type as field 3."""
    model = SentencePieceModel()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            model.pieces.append((own.get(1, b"").decode(), score, own.get(3, 1)))
        elif number == 2:
            model.model_type = dict(_fields(value)).get(3, 1)
    if not model.pieces:
        raise ValueError("the model has no pieces")
    return model


class SentencePieceTokenizer:
    """Text to ids and back by the model's own type: a character model here, any other one by the sentencepiece library.

    Pickles as the bytes of the model.
    """

    def __init__(self, data: bytes):
        self.data, self.model = data, read_spm_model(data)
        self._library = None

    def __reduce__(self):
        return SentencePieceTokenizer, (self.data,)

    def library(self):
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._library

    def encode(self, text: str, most: int | None = None) -> list[int]:
        if self.model.is_char:
            vocab, unknown = self.model.vocab, self.model.unknown
            ids = [vocab.get(c, unknown) for c in "\u2581" + text.replace(" ", "\u2581")]
        else:
            ids = list(self.library().encode(text))
        return ids if most is None else ids[:most]

    def decode(self, ids: list[int]) -> str:
        if not self.model.is_char:
            return self.library().decode([int(i) for i in ids])
        pieces = [self.model.pieces[i] for i in ids if 0 <= i < len(self.model.pieces)]
        return "".join(t for t, _, kind in pieces if kind == 1).replace("\u2581", " ").removeprefix(" ")

    __call__ = encode
