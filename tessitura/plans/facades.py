"""Whole tasks over DataFrames: voice activity, recognition, synthesis, codecs, ingestion.

Options are dataclass fields with their defaults.  Input columns are kept.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions import arrays as A
from tessitura.functions import tokens as K
from tessitura.functions.mel import at_rate, whisper_features
from tessitura.functions.text import PHONEMES, packed_sentences
from tessitura.operators import segment, speech, transcripts
from tessitura.scoring import loops
from tessitura.scoring.sessions import Model, Shared
from tessitura.sources.wav import Audio, encode, resample


class Opened(Protocol):
    """Anything with a session(): a Model, or what a test or another runtime brings."""

    def session(self) -> Any: ...


class SpeechToText(Protocol):
    """A recogniser: WAV bytes and a language to text."""

    def __call__(self, wav: bytes, language: str | None) -> str: ...


def _shared(df: DataFrame, *models: Opened | None):
    return [Shared(df.sparkSession, m) for m in models]


SPEECH = "array<struct<island:int,start:double,end:double,confidence:double>>"


@dataclass
class VoiceActivity:
    """Speech segments of signals.  ``rate`` is the model's; signals of another ``source_rate`` are resampled first.

    A signal is scored and cut within its row: rows may share a key, and nothing is shuffled.
    """

    model: Opened
    threshold: float = 0.5
    min_speech: float = 0.25
    min_silence: float = 0.1
    pad: float = 0.03
    window: int = 512
    rate: int = 16000
    source_rate: int | None = None

    def _scorer(self, df: DataFrame, source_rate: int | None) -> Callable[[np.ndarray], np.ndarray]:
        (model,) = _shared(df, self.model)
        rate, window, source = self.rate, self.window, source_rate or self.source_rate or self.rate
        return lambda x: loops.speech_probabilities(model.value.session(), resample(Audio(np.asarray(x, np.float32), source), rate).samples, rate, window)[0]

    def probabilities(self, df: DataFrame, input: str = "Audio", output: str = "probs", source_rate: int | None = None) -> DataFrame:
        """df with the probability of speech in each full window."""
        own = self._scorer(df, source_rate)

        @F.pandas_udf("array<float>")
        def score(signals: pd.Series) -> pd.Series:
            return signals.map(lambda x: None if x is None else own(x))

        return df.withColumn(output, score(input))

    def detected(self, df: DataFrame, input: str = "Audio", output: str = "speech", source_rate: int | None = None, **overrides) -> DataFrame:
        """df with the segments of each signal, an array; options may be given for this call."""
        own, frame = self._scorer(df, source_rate), self.window / self.rate
        options = {"threshold": self.threshold, "min_speech": self.min_speech, "min_silence": self.min_silence, "pad": self.pad} | overrides

        @F.pandas_udf(SPEECH)
        def cut(signals: pd.Series) -> pd.Series:
            return signals.map(lambda x: None if x is None else [dict(zip(("island", "start", "end", "confidence"), s, strict=True)) for s in speech.cut_segments(own(x), frame, **options)])

        return df.withColumn(output, cut(input))

    def segments(self, df: DataFrame, key: str, input: str = "Audio", **options) -> DataFrame:
        """key, island, start, end, confidence of each segment, in seconds of the signal."""
        return self.detected(df.select(key, input), input, "_s", **options).select(key, F.inline("_s"))

    def summary(self, df: DataFrame, key: str | None = None, input: str = "Audio", **options) -> DataFrame:
        """df with SegmentCount, TotalSpeechSeconds, SegmentStarts, SegmentEnds and SegmentConfidences."""
        s = F.coalesce(F.col("_s"), F.array().cast(SPEECH))
        part = lambda name: F.transform(s, lambda x: x[name])
        made = self.detected(df, input, "_s", **options)
        return made.select(
            *(F.col(f"`{c}`") for c in df.columns), F.size(s).alias("SegmentCount"), F.aggregate(s, F.lit(0.0), lambda t, x: t + x["end"] - x["start"]).alias("TotalSpeechSeconds"),
            part("start").alias("SegmentStarts"), part("end").alias("SegmentEnds"), part("confidence").alias("SegmentConfidences"),
        )

    def chunks(self, df: DataFrame, key: str | None = None, input: str = "Audio", source_rate: int | None = None, **options) -> DataFrame:
        """The samples of each segment, at the rate of the signal, one row each."""
        rate = source_rate or self.source_rate or self.rate
        made = self.detected(df, input, "_s", source_rate, **options).select(*(F.col(f"`{c}`") for c in df.columns), F.inline("_s"))
        first, last = F.floor(F.col("start") * rate).cast("int"), F.floor(F.col("end") * rate).cast("int")
        return made.withColumn("content", F.slice(input, first + 1, last - first))


@dataclass
class Whisper:
    """Recognition by an encoder and a decoder model, with a vocabulary (id to token)."""

    encoder: Opened
    decoder: Opened
    vocab: dict[int, str]
    language: str | None = None
    translate: bool = False
    max_tokens: int = 256
    bins: int = 80
    temperature: float = 0.0
    layers: int = 0
    heads: int = 0
    rate: int = 16000
    seed: int = 0
    special: K.SpecialTokens = field(default_factory=K.SpecialTokens)
    with_prompt: bool = True

    def prompt(self) -> list[int]:
        known = self.special.languages().get(self.language or "")
        return [self.special.start, *([known] if known is not None else []), self.special.translate if self.translate else self.special.transcribe]

    def transform(self, df: DataFrame, input: str = "Audio", output: str = "Text") -> DataFrame:
        """df with output (text), segments and token_ids."""
        me = Shared(df.sparkSession, self)

        @F.pandas_udf("array<int>")
        def recognise(signals: pd.Series) -> pd.Series:
            w = me.value
            encoder, decoder = w.encoder.session(), w.decoder.session()

            def one(x):
                audio = resample(Audio(np.asarray(x, np.float32), w.rate), 16000).samples
                return loops.transcribe(encoder, decoder, whisper_features(audio, w.bins), w.prompt(), w.special.end, w.max_tokens, w.temperature, w.seed, w.with_prompt, w.layers, w.heads)

            return signals.map(lambda x: None if x is None else one(x))

        out = df.withColumn("token_ids", recognise(input))
        return out.withColumn(output, K.whisper_decode("token_ids", self.vocab, self.special)).withColumn("segments", K.whisper_segments("token_ids", self.vocab, self.special))

    def updates(self, df: DataFrame, key: str, input: str = "Audio", model_id: str | None = None) -> DataFrame:
        """The log of updates of each row."""
        return transcripts.update_log(self.transform(df, input, "text"), key, model_id=model_id)

    def response(self, df: DataFrame, key: str, input: str = "Audio") -> DataFrame:
        return transcripts.response(self.transform(df, input, "text"), key).withColumn("language", F.lit(self.language).cast("string"))


class Generator(Protocol):
    """A runtime that makes all tokens of a clip itself: features (1, bins, frames), a prompt and options to ids."""

    def generate(self, features: np.ndarray, prompt: Sequence[int], **options: Any) -> Sequence[int]: ...


@dataclass
class GenerativeWhisper:
    """Recognition by a generating runtime: it has the loop, the cache and the search, and gives ids up to the end.

    open: what gives a Generator on a worker, once for each process that unpickles it.
    """

    open: Callable[[], Generator]
    vocab: dict[int, str]
    language: str | None = None
    translate: bool = False
    max_length: int = 448
    beams: int = 1
    bins: int = 80
    rate: int = 16000
    special: K.SpecialTokens = field(default_factory=K.SpecialTokens)

    def transform(self, df: DataFrame, input: str = "Audio", output: str = "Text") -> DataFrame:
        """df with output (text), segments and token_ids; the ids have no prompt."""
        me = Shared(df.sparkSession, self)
        prompt = Whisper(None, None, {}, self.language, self.translate, special=self.special).prompt()  # type: ignore[arg-type]

        @F.pandas_udf("array<int>")
        def recognise(signals: pd.Series) -> pd.Series:
            w = me.value
            runtime = w.open()

            def one(x):
                audio = resample(Audio(np.asarray(x, np.float32), w.rate), 16000).samples
                features = np.ascontiguousarray(whisper_features(audio, w.bins).T)[None]
                ids = list(runtime.generate(features, prompt, max_length=w.max_length, num_beams=w.beams))
                ids = ids[len(prompt) :] if ids[: len(prompt)] == prompt else ids
                return ids[: ids.index(w.special.end)] if w.special.end in ids else ids

            return signals.map(lambda x: None if x is None else one(x))

        out = df.withColumn("token_ids", recognise(input))
        return out.withColumn(output, K.whisper_decode("token_ids", self.vocab, self.special)).withColumn("segments", K.whisper_segments("token_ids", self.vocab, self.special))


@dataclass
class SpeechClient:
    """Recognition by a callable that takes WAV bytes: a service, or another library."""

    client: SpeechToText
    rate: int = 16000
    language: str | None = None

    def transform(self, df: DataFrame, input: str = "Audio", output: str = "Text") -> DataFrame:
        client, rate, language = self.client, self.rate, self.language

        @F.pandas_udf("string")
        def ask(signals: pd.Series) -> pd.Series:
            return signals.map(lambda x: None if x is None else client(encode(Audio(np.asarray(x, np.float32), rate)), language) or "")

        return df.withColumn(output, ask(input))


@dataclass
class SpeechT5:
    """Synthesis by an encoder, a decoder and a vocoder.  tokenize: text to ids, such as a character model's."""

    encoder: Opened
    decoder: Opened
    vocoder: Opened
    tokenize: Callable[[str], Sequence[int]]
    speaker: np.ndarray
    bins: int = 80
    max_frames: int = 1000
    stop: float = 0.5
    rate: int = 16000

    def synthesize(self, text: str) -> np.ndarray:
        return loops.speecht5(self.encoder.session(), self.decoder.session(), self.vocoder.session(), self.tokenize(text), self.speaker, self.bins, self.max_frames, self.stop)

    def transform(self, df: DataFrame, input: str = "Text", output: str = "Audio") -> DataFrame:
        return synthesised(self, df, input, output)


_PHONEME_IDS = {s: i for i, s in enumerate(PHONEMES)}


def phoneme_ids(text: str) -> list[int]:
    """Ids of a text's words and signs, joined by spaces; signs without an id are left out."""
    import regex

    normal = " ".join(regex.findall(r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}\s]", text))
    return [_PHONEME_IDS[c] for c in normal if c in _PHONEME_IDS]


@dataclass
class Kitten:
    """Synthesis by one model and a table of voices.  phonemize: a chunk to its phonemes; None takes it as it is."""

    model: Opened
    voices: dict[str, np.ndarray]
    voice: str = "Jasper"
    speed: float = 1.0
    max_length: int = 400
    trim: int = 5000
    rate: int = 24000
    phonemize: Callable[[str], str] | None = None
    encode: Callable[[str], Sequence[int]] = phoneme_ids

    def synthesize(self, text: str) -> np.ndarray:
        chunks = packed_sentences(text, self.max_length, lambda s: len(self.encode(s)))
        return loops.kitten(self.model.session(), chunks, self.encode, self.voices, self.voice, self.speed, self.trim, self.phonemize)

    def transform(self, df: DataFrame, input: str = "Text", output: str = "Audio") -> DataFrame:
        return synthesised(self, df, input, output)


def synthesised(engine: SpeechT5 | Kitten, df: DataFrame, input: str, output: str) -> DataFrame:
    me = Shared(df.sparkSession, engine)

    @F.pandas_udf("array<float>")
    def speak(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else me.value.synthesize(t))

    return df.withColumn(output, speak(input))


class SpeechEngines:
    """Synthesis by name: WAV bytes, and the log of a request."""

    def __init__(self, **engines: SpeechT5 | Kitten):
        self.engines = engines

    def engine(self, name: str) -> SpeechT5 | Kitten:
        if name not in self.engines:
            raise ValueError(f"no engine {name!r}; there are {sorted(self.engines)}")
        return self.engines[name]

    def wav(self, df: DataFrame, name: str, input: str = "Text", output: str = "content") -> DataFrame:
        from tessitura.sources.wav import encode_wav

        e = self.engine(name)
        return e.transform(df, input, "_audio").withColumn(output, encode_wav("_audio", e.rate)).drop("_audio")

    def updates(self, df: DataFrame, name: str, key: str, input: str = "Text") -> DataFrame:
        """seq, kind and content: SessionOpen, AudioUpdated, SessionClose for each row; Error in place of the audio that failed."""
        me, rate = Shared(df.sparkSession, self.engine(name)), self.engine(name).rate

        @F.pandas_udf("content binary, error string")
        def speak(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                try:
                    rows.append((encode(Audio(me.value.synthesize(t or ""), rate)), None))
                except Exception as e:  # what a request reports
                    rows.append((None, str(e)))
            return pd.DataFrame(rows, columns=["content", "error"])

        made = df.select(key, speak(input).alias("s"))
        event = lambda kind, content, error: F.struct(kind.alias("kind"), content.alias("content"), error.alias("error"))
        none, no_error = F.lit(None).cast("binary"), F.lit(None).cast("string")
        middle = event(F.when(F.col("s.error").isNull(), "AudioUpdated").otherwise("Error"), F.col("s.content"), F.col("s.error"))
        log = F.array(event(F.lit("SessionOpen"), none, no_error), middle, event(F.lit("SessionClose"), none, no_error))
        return made.select(key, F.posexplode(log).alias("seq", "e")).select(key, "seq", "e.*")


@dataclass
class Codec:
    """Signals to codes (array<array<int>>, by codebook) and back."""

    encoder: Opened | None = None
    decoder: Opened | None = None
    books: int = 8
    rate: int = 24000
    size: int = 1024
    source_rate: int | None = None  # of signals to encode, if it isn't the codec's
    channels: int = 1

    @classmethod
    def at(cls, kbps: float, **options) -> Codec:
        return cls(books=loops.CODEBOOKS[kbps], **options)

    @property
    def hop(self) -> int:
        return loops.codec_hop(self.rate)

    def encode(self, df: DataFrame, input: str = "Audio", output: str = "codes") -> DataFrame:
        if self.encoder is None:
            raise ValueError("encoding needs an encoder model")
        (model,), books = _shared(df, self.encoder), self.books
        own = lambda x, source=self.source_rate, channels=self.channels, rate=self.rate: at_rate(x, source, channels, rate)

        @F.pandas_udf("array<array<int>>")
        def run(signals: pd.Series) -> pd.Series:
            return signals.map(lambda x: None if x is None else loops.codec_encode(model.value.session(), own(x), books).tolist())

        return df.withColumn(output, run(input))

    def decode(self, df: DataFrame, input: str = "codes", output: str = "Audio") -> DataFrame:
        if self.decoder is None:
            raise ValueError("decoding needs a decoder model")
        (model,) = _shared(df, self.decoder)

        @F.pandas_udf("array<float>")
        def run(codes: pd.Series) -> pd.Series:
            return codes.map(lambda c: None if c is None else loops.codec_decode(model.value.session(), np.stack([np.asarray(b) for b in c])))

        return df.withColumn(output, run(input))

    def flatten(self, codes: Column | str) -> Column:
        return A.codec_flatten(codes, self.size)


class EspeakPhonemizer:
    """Phonemes by the espeak-ng program, which has to be on the executors.  Without it a call says so."""

    def __init__(self, language: str = "en-us", program: str | None = None, timeout: float = 10.0):
        self.language, self.program, self.timeout = language, program, timeout

    def resolve(self) -> str:
        found = self.program or shutil.which("espeak-ng") or next((p for p in ("/usr/bin/espeak-ng", "/usr/local/bin/espeak-ng") if shutil.which(p)), None)
        if not found or not shutil.which(found):
            raise FileNotFoundError("espeak-ng isn't installed; name its path")
        return found

    def __call__(self, text: str) -> str:
        done = subprocess.run([self.resolve(), "--ipa", "-q", "--sep= ", "-v", self.language, text], capture_output=True, text=True, timeout=self.timeout)
        if done.returncode:
            raise RuntimeError(f"espeak-ng failed: {done.stderr.strip()}")
        return done.stdout.strip()


def phonemize_chunks(chunks: DataFrame, phonemizer: Callable[[str], str], language: str = "en-us", content: str = "content") -> DataFrame:
    """chunks with phonemes as content, the text as original_text, and the language."""

    @F.pandas_udf("string")
    def phonemes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else phonemizer(t))

    return chunks.withColumn("original_text", F.col(content)).withColumn(content, phonemes("original_text")).withColumn("language", F.lit(language))


def ingest(documents: DataFrame, rate: int = 16000, seconds: float = 2.0) -> DataFrame:
    """Documents of read_audio_documents to chunks: source_file, segment_index, start_sec, end_sec, content."""
    audio = documents.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("audio.samples").alias("samples"))
    return segment.segment_audio(audio, "samples", rate, seconds).select("source_file", "segment_index", "start_sec", "end_sec", "content")


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """chunks with a metadata map of strings, as other readers of chunks expect it."""
    two = lambda c: F.format_string("%.2f", c)
    pairs = {"startTime": two(F.col("start_sec")), "endTime": two(F.col("end_sec")), "segmentIndex": F.col("segment_index").cast("string"), "sourceFile": F.col("source_file")}
    return chunks.withColumn("metadata", F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))))


def embed_chunks(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """chunks with an embedding of each; embed adds one to a DataFrame with a content column."""
    return embed(chunks)


__all__ = ["Codec", "EspeakPhonemizer", "GenerativeWhisper", "Kitten", "Model", "SpeechClient", "SpeechEngines", "SpeechT5", "VoiceActivity", "Whisper", "chunk_metadata", "embed_chunks", "ingest", "phonemize_chunks"]
