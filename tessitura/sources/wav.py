"""WAV files: decoding, encoding, scanning and writing.

Samples are float32 and mono once decoded; a struct<samples, sample_rate, channels>
column holds a signal.  The codec is numpy on Arrow batches.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = "struct<samples:array<float>,sample_rate:int,channels:int>"
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


class WavError(ValueError):
    """Bytes that aren't a WAV file this module reads."""


@dataclass(frozen=True)
class Audio:
    """Interleaved float samples.  Its duration counts samples and not frames, as its users expect of mono signals."""

    samples: np.ndarray
    sample_rate: int = 16000
    channels: int = 1

    def __post_init__(self):
        if self.samples is None or self.sample_rate <= 0 or self.channels <= 0:
            raise ValueError("a signal needs samples, a rate and channels")

    @property
    def duration(self) -> float:
        return len(self.samples) / self.sample_rate

    @classmethod
    def empty(cls, sample_rate: int = 16000) -> Audio:
        return cls(np.zeros(0, np.float32), sample_rate)


def _chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the chunks of a RIFF file; odd ones are followed by a byte of padding."""
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(len(data), at + 8 + size)
        at += 8 + size + size % 2


def header(data: bytes) -> dict[str, int]:
    """format, channels, sample_rate, bits, and where the samples are."""
    if len(data) < 12 or data[:4] != b"RIFF":
        raise WavError("no RIFF header")
    if data[8:12] != b"WAVE":
        raise WavError("not a WAVE file")
    found: dict[str, int] = {}
    for name, begin, end in _chunks(data):
        if name == b"fmt " and "format" not in found:
            if end - begin < 16:
                raise WavError("the format chunk is too short")
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, begin)
            if kind == EXTENSIBLE and end - begin >= 26:
                kind = struct.unpack_from("<H", data, begin + 24)[0]
            found |= {"format": kind, "channels": channels, "sample_rate": rate, "bits": bits}
        elif name == b"data" and "begin" not in found:
            found |= {"begin": begin, "end": end}
    if "format" not in found:
        raise WavError("no format chunk")
    if "begin" not in found:
        raise WavError("no data chunk")
    return found


def decode(data: bytes) -> Audio:
    """The file as a mono signal: 8, 16 and 24 bits and float; channels are averaged."""
    h = header(data)
    raw = data[h["begin"] : h["end"]]
    kind = (h["format"], h["bits"])
    if kind == (PCM, 16):
        x = np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.float32) / np.float32(32767)
    elif kind == (PCM, 8):
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / np.float32(128)
    elif kind == (PCM, 24):
        b = np.frombuffer(raw, np.uint8, len(raw) // 3 * 3).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24 | b[:, 1] << 16 | b[:, 0] << 8) >> 8).astype(np.float32)) / np.float32(8388608)
    elif kind == (FLOAT, 32):
        x = np.frombuffer(raw, "<f4", len(raw) // 4).astype(np.float32)
    else:
        raise WavError(f"no decoder for format {kind[0]} of {kind[1]} bits")
    channels = max(1, h["channels"])
    if channels > 1:
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1, dtype=np.float32)
    return Audio(x, h["sample_rate"])


def encode(audio: Audio) -> bytes:
    """A file of 16-bit samples: clamped, scaled and cut towards zero."""
    x = np.nan_to_num(np.clip(np.asarray(audio.samples, np.float32), -1, 1))
    data = (x * np.float32(32767)).astype("<i2").tobytes()
    rate, channels = audio.sample_rate, audio.channels
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, PCM, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(data)) + data


def resample(audio: Audio, rate: int) -> Audio:
    """By linear interpolation, without a filter."""
    if rate == audio.sample_rate:
        return audio
    step, n = audio.sample_rate / rate, len(audio.samples)
    place = np.arange(int(n / step)) * step
    low = place.astype(np.int64)
    part = place - low
    x = np.asarray(audio.samples, float)
    return Audio((x[low] * (1 - part) + x[np.minimum(low + 1, n - 1)] * part).astype(np.float32) if n else audio.samples, rate, audio.channels)


def to_mono(audio: Audio) -> Audio:
    if audio.channels == 1:
        return audio
    x = np.asarray(audio.samples, np.float32)
    return Audio(x[: len(x) // audio.channels * audio.channels].reshape(-1, audio.channels).mean(axis=1), audio.sample_rate)


def decode_wav(content: Column | str, rate: int | None = None, errors: str = "raise") -> Column:
    """Bytes to a signal, at ``rate`` if given; with errors="null" what can't be read is null."""

    @F.pandas_udf(AUDIO)
    def read(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                a = None if data is None else decode(bytes(data))
            except WavError:
                if errors == "raise":
                    raise
                a = None
            if a is not None and rate:
                a = resample(a, rate)
            rows.append((None, None, None) if a is None else (a.samples, a.sample_rate, a.channels))
        return pd.DataFrame(rows, columns=["samples", "sample_rate", "channels"]).astype({"sample_rate": "Int32", "channels": "Int32"})

    out = read(content)
    return F.when(out["sample_rate"].isNotNull(), out)


def encode_wav(samples: Column | str, rate: int = 16000, channels: int = 1) -> Column:
    @F.pandas_udf("binary")
    def write(signals: pd.Series) -> pd.Series:
        return signals.map(lambda x: None if x is None else encode(Audio(x, rate, channels)))

    return write(samples)


def wav_header(content: Column | str) -> Column:
    """channels, sample_rate and bits of a file whose format chunk comes first, without decoding it."""
    c = F.col(content) if isinstance(content, str) else content

    def number(at: int, n: int) -> Column:
        return F.conv(F.hex(F.concat(*(F.substring(c, at + i, 1) for i in range(n, 0, -1)))), 16, 10).cast("int")

    return F.struct(number(22, 2).alias("channels"), number(24, 4).alias("sample_rate"), number(34, 2).alias("bits"))


def scan_wav(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """path, modificationTime, length and content of the files below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_audio_documents(spark: SparkSession, path: str, rate: int = 16000, glob: str = "*.wav") -> DataFrame:
    """path, audio and a line that describes it, for each file."""
    files = scan_wav(spark, path, glob).select("path", decode_wav("content", rate).alias("audio"))
    n, sr = F.size("audio.samples"), F.col("audio.sample_rate")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("summary", F.format_string("Audio file: %s, Duration: %.2fs, SampleRate: %dHz, Samples: %d", name, n / sr, sr, n))


def save_wav(df: DataFrame, folder: str, name: str, samples: str, rate: int = 16000) -> DataFrame:
    """Writes a file for each row into a folder that all executors share; path and size of each.

    A file is written under another name and then moved, so that a task may run twice.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for own, x in zip(batch["name"], batch["samples"], strict=True):
                data = encode(Audio(x, rate))
                temporary = f"{root}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(temporary) as out:
                    out.write(data)
                fs.move(temporary, f"{root}/{own}.wav")
                rows.append((f"{root}/{own}.wav", len(data)))
            yield pd.DataFrame(rows, columns=["path", "size"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(samples).alias("samples")).mapInPandas(write, "path string, size long")
