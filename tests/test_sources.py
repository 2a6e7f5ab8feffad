"""WAV, NPY, NPZ and SentencePiece readers, and mel features."""

import io
import struct

import numpy as np
import pytest

from tessitura.functions import mel
from tessitura.scoring.tiny import _field
from tessitura.sources import models, wav


def riff(fmt: bytes, data: bytes, extra: bytes = b"") -> bytes:
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def fmt(kind, channels, bits, rate=16000):
    return struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)


def test_formats():
    assert wav.decode(riff(fmt(1, 1, 16), np.array([-32768, 0, 32767], "<i2").tobytes())).samples.tolist() == [np.float32(-32768) / np.float32(32767), 0, 1]
    assert wav.decode(riff(fmt(1, 1, 8), bytes([0, 128, 192]))).samples.tolist() == [-1, 0, 0.5]
    assert wav.decode(riff(fmt(1, 1, 24), b"\x00\x00\x40\x00\x00\x80")).samples.tolist() == [0.5, -1]
    assert wav.decode(riff(fmt(3, 2, 32), np.array([0.5, 0.25, 1, 0, 9], "<f4").tobytes())).samples.tolist() == [0.375, 0.5]
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert wav.decode(riff(fmt(1, 1, 16), b"\0\0", odd)).sample_rate == 16000
    wide = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 0) + struct.pack("<H", 1) + b"\0" * 14
    assert wav.decode(riff(wide, b"\0\0")).sample_rate == 8000
    assert len(wav.decode(riff(fmt(1, 1, 16), b"")).samples) == 0


@pytest.mark.parametrize("data", [b"", b"RIFX" + b"\0" * 20, b"RIFF\0\0\0\0WAVX", b"RIFF\0\0\0\0WAVE", riff(fmt(7, 1, 8), b"\0"), b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 16) + fmt(1, 1, 16)])
def test_errors(data):
    with pytest.raises(wav.WavError):
        wav.decode(data)


def test_round_trip_and_resample():
    x = np.random.default_rng(0).uniform(-1.2, 1.2, 500).astype(np.float32)
    back = wav.decode(wav.encode(wav.Audio(x))).samples
    assert np.abs(back - np.clip(x, -1, 1)).max() <= 1 / 32767
    assert wav.resample(wav.Audio(x), 16000).samples is x
    assert len(wav.resample(wav.Audio(x), 8000).samples) == 250 and len(wav.resample(wav.Audio.empty(), 8000).samples) == 0
    assert wav.to_mono(wav.Audio(np.array([1, 0, 0.5, 0.5, 9], np.float32), 16000, 2)).samples.tolist() == [0.5, 0.5]
    with pytest.raises(ValueError):
        wav.Audio(x, 0)


def test_scan(spark, tmp_path):
    (tmp_path / "test.wav").write_bytes(wav.encode(wav.Audio(np.zeros(64000, np.float32))))
    docs = wav.read_audio_documents(spark, str(tmp_path))
    assert docs.first().summary == "Audio file: test.wav, Duration: 4.00s, SampleRate: 16000Hz, Samples: 64000"
    from tessitura.plans.facades import chunk_metadata, ingest

    chunks = chunk_metadata(ingest(docs, seconds=1.0)).orderBy("segment_index").collect()
    assert [(c.start_sec, c.end_sec, c.metadata["endTime"]) for c in chunks] == [(float(i), i + 1.0, f"{i + 1}.00") for i in range(4)]
    head = wav.scan_wav(spark, str(tmp_path)).select(wav.wav_header("content").alias("h")).first().h
    assert (head.channels, head.sample_rate, head.bits) == (1, 16000, 16)
    saved = wav.save_wav(spark.createDataFrame([("a", [0.5] * 10)], "name string, x array<float>"), str(tmp_path / "out"), "name", "x").first()
    assert len(wav.decode(open(saved.path, "rb").read()).samples) == 10 and saved.size == 64


def test_models(spark):
    out = io.BytesIO()
    np.save(out, np.arange(6, dtype=np.float32).reshape(2, 3))
    assert models.read_npy_vector(out.getvalue()).tolist() == [0, 1, 2, 3, 4, 5]
    out = io.BytesIO()
    np.savez(out, a=np.ones((2, 3), np.float32), b=np.zeros(3, np.float32))
    voices = models.read_npz_voices(out.getvalue())
    assert voices["a"].shape == (2, 3) and voices["b"].shape == (1, 3)
    assert models.voice_table(spark, voices).count() == 3
    piece = lambda t, kind: _field(1, _field(1, t) + b"\x15" + struct.pack("<f", -1.5) + _field(3, kind))
    m = models.read_spm_model(piece("<unk>", 2) + piece("▁", 1) + piece("a", 1) + _field(2, _field(3, 4)))
    assert m.is_char and m.vocab == {"<unk>": 0, "▁": 1, "a": 2} and m.unknown == 0 and m.pieces[2][1] == -1.5
    with pytest.raises(ValueError):
        models.read_spm_model(b"")


def test_mel():
    x = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    m = mel.mel_spectrogram(x)
    assert m.shape == (98, 80)
    assert abs(mel.to_hertz(np.linspace(0, mel.to_mel(8000), 82))[1 + m.mean(axis=0).argmax()] - 1000) < 60
    assert mel.mel_spectrogram(np.zeros(10)).shape == (0, 80)
    w = mel.whisper_features(x)
    assert w.shape == (3000, 80) and (w[98:] == 0).all() and mel.whisper_features(x, padded=False).shape == (98, 80)
    assert len(mel.whisper_chunks(np.zeros(480001))) == 2 and len(mel.whisper_chunks(np.zeros(0))) == 0
    with pytest.raises(ValueError):
        mel.whisper_chunks(x, overlap_frames=3000)


def test_tokenizers_by_type():
    import pickle

    import public_tokenizers

    from tessitura.sources.models import SentencePieceTokenizer

    piece = lambda t, kind=1: b"\x0a" + bytes([len(b := b"\x0a" + bytes([len(t.encode())]) + t.encode() + b"\x18" + bytes([kind])), *b])
    chars = b"".join([piece("<unk>", 2), piece("\u2581"), piece("a"), piece("b"), b"\x12\x02\x18\x04"])
    t = pickle.loads(pickle.dumps(SentencePieceTokenizer(chars)))
    assert t.encode("ab z") == [1, 2, 3, 1, 0] and t.decode([1, 2, 3, 1, 0, 99]) == "ab " and t("ab", 2) == [1, 2]
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        t = SentencePieceTokenizer(f.read())
    assert not t.model.is_char and t.decode(t.encode("Speech to text, and back.")) == "Speech to text, and back."


def test_style_rows(spark):
    from pyspark.sql import functions as F

    from tessitura.sources.models import style_rows

    styles = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "row_idx int, style array<float>")
    df = spark.createDataFrame([(i,) for i in range(9)], "n int")
    for small in (100, 2):
        assert sorted((r.n, r.style[0]) for r in style_rows(df, styles, F.col("n"), small=small).collect()) == [(i, float(min(i, 4))) for i in range(9)]
