"""Stages and facades, with models written by hand and sessions written in Python."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessitura.functions.mel import MelOptions, mel_spectrogram
from tessitura.plans import facades as P
from tessitura.plans import stages as S
from tessitura.scoring import loops, tiny
from tessitura.scoring.sessions import Model, describe


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Tensor:
    def __init__(self, name, shape, type="tensor(float)"):
        self.name, self.shape, self.type = name, shape, type


class Fake:
    """A session and what opens it."""

    def __init__(self, inputs, outputs, f):
        self.ins, self.outs, self.f = inputs, outputs, f

    def session(self):
        return self

    def get_inputs(self):
        return self.ins

    def get_outputs(self):
        return self.outs

    def run(self, names, feeds):
        out = self.f(feeds)
        return [out[n] for n in (names or [o.name for o in self.outs])]


def encoder():
    return Fake([Tensor("input_features", [1, 80, 3000])], [Tensor("last_hidden_state", [1, "t", 4])], lambda x: {"last_hidden_state": np.ones((1, 3, 4), np.float32) * x["input_features"].shape[1]})


SCRIPT = [50362, 5, 6, 50412, 7, 50462, 8, 50512, 50257]


def decoder(cached):
    """Says SCRIPT, one token a step; remembers the number of tokens that it saw as keys if it has a cache."""

    def f(x):
        past = x["past_key_values.0.decoder.key"].shape[2] if cached else 0
        seen = past + x["input_ids"].shape[1]
        logits = np.zeros((1, x["input_ids"].shape[1], 51000), np.float32)
        logits[0, -1, SCRIPT[seen - 3]] = 9
        out = {"logits": logits}
        if cached:
            assert bool(x["use_cache_branch"][0]) == (past > 0)
            kv = np.zeros((1, 2, seen, 3), np.float32)
            out |= {f"present.0.{s}.{k}": kv if s == "decoder" else np.zeros((1, 2, 3, 3), np.float32) for s in ("decoder", "encoder") for k in ("key", "value")}
        return out

    names = [f"0.{s}.{k}" for s in ("decoder", "encoder") for k in ("key", "value")] if cached else []
    ins = [Tensor("input_ids", [1, "n"]), Tensor("encoder_hidden_states", [1, "t", 4]), Tensor("use_cache_branch", [1])] + [Tensor(f"past_key_values.{n}", [1, 2, "n", 3]) for n in names]
    return Fake(ins, [Tensor("logits", [1, "n", 51000])] + [Tensor(f"present.{n}", [1, 2, "n", 3]) for n in names], f)


@pytest.mark.parametrize("cached", [True, False])
def test_transcribe(cached):
    ids = loops.transcribe(encoder(), decoder(cached), np.zeros((3000, 80)), [50258, 50259, 50358], 50257)
    assert ids == [50258, 50259, 50358, *SCRIPT[:-1]]
    assert loops.transcribe(encoder(), decoder(cached), np.zeros((3000, 80)), [50258, 50259, 50358], 50257, most=2, with_prompt=False) == SCRIPT[:2]


def test_whisper_facade(spark):
    df = spark.createDataFrame([(1, [0.1] * 800), (2, None)], "id int, Audio array<float>")
    w = P.Whisper(encoder(), decoder(True), {5: " a", 6: "b", 7: " c", 8: " d"}, language="en")
    out = {r.id: r for r in w.transform(df).collect()}
    assert out[1].Text == " ab c d" and out[1].Audio is not None
    # text between two segments goes into the second one
    assert [(s.text, round(s.start, 2), round(s.end, 2)) for s in out[1].segments] == [("ab", 0.0, 1.0), ("c d", 2.0, 3.0)]
    assert out[2].token_ids is None
    log = [r.kind for r in w.updates(df.where("id = 1"), "id").orderBy("seq").collect()]
    assert log == ["SessionOpen", "TextUpdated", "TextUpdated", "SessionClose"]
    r = w.response(df.where("id = 1"), "id").first()
    assert (r.start, r.n_segments, r.language) == (0.0, 2, "en") and round(r.end, 2) == 3.0


def test_sample_temperature():
    rng = np.random.default_rng(1)
    draws = [loops.sample(np.array([0.0, np.log(3)]), 1.0, rng) for _ in range(2000)]
    assert 0.7 < np.mean(draws) < 0.8
    assert loops.sample(np.array([1.0, 1.0]), 0, rng) == 0


def test_voice_activity(spark):
    loud, quiet = [0.9] * 16 * 20, [0.0] * 16 * 20
    df = spark.createDataFrame([(1, quiet + loud + quiet), (2, quiet)], "id int, Audio array<float>")
    vad = P.VoiceActivity(Model(tiny.recurrent(16)), window=16, rate=500)
    out = {r.id: r for r in vad.summary(df, "id").collect()}
    assert out[1].SegmentCount == 1 and out[2].SegmentCount == 0 and out[2].SegmentStarts == []
    assert 0.5 < out[1].SegmentStarts[0] < 0.75 and 1.2 < out[1].SegmentEnds[0] < 1.4
    chunk = vad.chunks(df, "id").first()
    assert len(chunk.content) == int(chunk.end * 500) - int(chunk.start * 500)
    p, state = loops.speech_probabilities(Model(tiny.recurrent(16)).session(), np.ones(32), 500, 16)
    q, _ = loops.speech_probabilities(Model(tiny.recurrent(16)).session(), np.ones(32), 500, 16, state)
    whole, _ = loops.speech_probabilities(Model(tiny.recurrent(16)).session(), np.ones(64), 500, 16)
    assert np.allclose(np.concatenate([p, q]), whole)


def test_classification_and_embedding(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=(8, 3))
    options = MelOptions(bins=8)
    df = spark.createDataFrame([(i, rng.normal(size=800 + 160 * i).astype(float).tolist()) for i in range(4)], "id int, Audio array<float>")
    rows = {r.id: r for r in S.embedding(Model(tiny.frame_matmul(w)), "mean", True, options).transform(df).collect()}
    for i, r in rows.items():
        e = (mel_spectrogram(np.array(r.Audio, np.float32), options) @ w.astype(np.float32)).mean(axis=0)
        assert np.allclose(r.Embedding, e / np.linalg.norm(e), atol=1e-4), i
    assert S.embedding_dimension(Model(tiny.frame_matmul(w))) == 3
    fixed = Model(tiny.frame_matmul(w, 4))
    out = S.classification(fixed, ["a", "b"], options).transform(df).collect()
    for r in out:
        m = np.zeros((4, 8), np.float32)
        own = mel_spectrogram(np.array(r.Audio, np.float32), options)[:4]
        m[: len(own)] = own
        z = (m @ w.astype(np.float32)).ravel()
        p = np.exp(z - z.max())
        p /= p.sum()
        assert np.allclose(r.Probabilities, p, atol=1e-4)
        assert r.PredictedLabel == (["a", "b"] + [f"Class_{i}" for i in range(2, 12)])[int(z.argmax())]
    assert not describe(fixed.session()).pooled and describe(Model(tiny.matmul(w)).session()).pooled


def test_features_of_any_signal(spark):
    from tessitura.sources.wav import Audio, resample, to_mono

    rng = np.random.default_rng(3)
    o = MelOptions(bins=8)
    rows = [(i, rng.normal(size=9000 + i).astype(np.float32).tolist(), rate, width) for i, (rate, width) in enumerate([(44100, 2), (16000, 1), (8000, 2), (48000, 1)])]
    df = spark.createDataFrame(rows, "id int, Audio array<float>, rate int, width int")
    for stage, data in (
        (S.ExtractFeatures(o, source_rate="rate", channels="width"), df),
        (S.ExtractFeatures(o, "a"), df.withColumn("a", F.struct(F.col("Audio").alias("samples"), F.col("rate").alias("sample_rate"), F.col("width").alias("channels")))),
    ):
        for r in stage.transform(data).collect():
            m = mel_spectrogram(resample(to_mono(Audio(np.array(r.Audio, np.float32), r.rate, r.width)), 16000).samples, o)
            assert r.Features.frames == len(m) and np.allclose(np.array(r.Features.data).reshape(m.shape), m, atol=1e-4)
    own = S.ExtractFeatures(o, extractor=lambda x: np.abs(x[:6]).reshape(3, 2).astype(np.float32)).transform(df).first()
    assert (own.Features.frames, own.Features.dim) == (3, 2)
    with pytest.raises(S.MissingColumn):
        S.ExtractFeatures(source_rate="nowhere").transform(df)


def test_embedding_generator(spark):
    rng = np.random.default_rng(1)
    model = Model(tiny.frame_matmul(rng.normal(size=(8, 3))))
    df = spark.createDataFrame([(1, rng.normal(size=900).tolist())], "id int, Audio array<float>")
    g = S.EmbeddingGenerator(model, "toy", options=MelOptions(bins=8))
    out = g.generate(df, source_rate=8000)
    assert g.metadata["dimensions"] == 3 and out.columns == ["id", "Audio", "Embedding"] and np.isclose(np.linalg.norm(out.first().Embedding), 1, atol=1e-5)


def test_speech_within_rows(spark):
    from tessitura.operators import speech

    rng = np.random.default_rng(5)
    streams = [np.repeat(rng.random(30) < 0.5, rng.integers(1, 9, 30)) * 0.8 + rng.random() * 0.1 for _ in range(20)] + [np.zeros(0), np.ones(3), np.ones(9)]
    frames = spark.createDataFrame([(k, i, float(p)) for k, x in enumerate(streams) for i, p in enumerate(x)], "key int, frame int, prob double")
    by_windows = {}
    for r in speech.speech_segments(frames, "key", "frame", "prob").collect():
        by_windows.setdefault(r.key, []).append((r.island, r.start, r.end, round(r.confidence, 9)))
    for k, x in enumerate(streams):
        assert [(a, b, c, round(d, 9)) for a, b, c, d in speech.cut_segments(x)] == sorted(by_windows.get(k, []))
    # rows of one key stay apart, and times are those of the signal at its own rate
    loud, quiet = [0.9] * 16 * 20, [0.0] * 16 * 20
    df = spark.createDataFrame([(1, quiet + loud + quiet), (1, quiet + loud)], "id int, Audio array<float>")
    vad = P.VoiceActivity(Model(tiny.recurrent(16)), window=16, rate=500)
    assert sorted(r.SegmentCount for r in vad.summary(df).collect()) == [1, 1] and vad.segments(df, "id").count() == 2
    double = df.select("id", F.flatten(F.transform("Audio", lambda x: F.array(x, x))).alias("Audio"))
    fast = P.VoiceActivity(Model(tiny.recurrent(16)), window=16, rate=500, source_rate=1000)
    assert sorted(len(r.content) for r in fast.chunks(double).collect()) == sorted(int(r.end * 1000) - int(r.start * 1000) for r in vad.segments(df, "id").collect())


def test_generating_recogniser(spark):
    class Runtime:
        def generate(self, features, prompt, **options):
            assert features.shape == (1, 80, 3000) and options["max_length"] == 448
            return [*prompt, *SCRIPT, 9]

    df = spark.createDataFrame([(1, [0.1] * 800), (2, None)], "id int, Audio array<float>")
    w = P.GenerativeWhisper(Runtime, {5: " a", 6: "b", 7: " c", 8: " d"}, language="en")
    out = {r.id: r for r in w.transform(df).collect()}
    assert out[1].Text == " ab c d" and out[1].token_ids == SCRIPT[:-1] and out[2].token_ids is None
    # text goes on to embeddings, and to speech
    kit = Fake([], [Tensor("w", ["n"])], lambda x: {"w": x["input_ids"][0].astype(np.float32)})
    said = P.Kitten(kit, {"Jasper": np.ones((3, 2))}, trim=0).transform(w.transform(df.where("id = 1")), "Text", "Speech").first()
    assert len(said.Speech) > 4
    embedded = P.embed_chunks(w.transform(df.where("id = 1")).withColumnRenamed("Text", "content"), lambda d: d.withColumn("embedding", F.array(F.length("content").cast("float"))))
    assert embedded.first().embedding == [7.0]


def test_missing_column_and_labels(spark):
    with pytest.raises(S.MissingColumn):
        S.ExtractFeatures().transform(spark.range(1))
    with pytest.raises(ValueError):
        S.SoftmaxLabel([])
    with pytest.raises(FileNotFoundError):
        Model.read("/nowhere.onnx")


def test_synthesis(spark):
    enc = Fake([Tensor("input_ids", [1, "n"])], [Tensor("h", [1, "n", 2])], lambda x: {"h": np.zeros((1, x["input_ids"].shape[1], 2), np.float32)})
    dec = Fake(
        [Tensor("output_sequence", [1, "n", 2]), Tensor("encoder_hidden_states", [1, "n", 2]), Tensor("speaker_embeddings", [1, 2])], [Tensor("output_sequence_out", [1, 1, 2]), Tensor("prob", [1])],
        lambda x: {"output_sequence_out": x["output_sequence"] + 1, "prob": np.array([x["output_sequence"][0, 0, 0] / 3])},
    )
    voc = Fake([Tensor("m", ["n", 2])], [Tensor("w", ["n"])], lambda x: {"w": x["m"][:, 0]})
    t5 = P.SpeechT5(enc, dec, voc, lambda t: [ord(c) for c in t], np.zeros(2), bins=2)
    # frames 1, 2, 3: the chance to stop passes one half at the third
    assert np.allclose(t5.synthesize("hi"), [1 / 3, 2 / 3, 1])
    kit = Fake([], [Tensor("w", ["n"])], lambda x: {"w": np.concatenate([x["input_ids"][0].astype(np.float32), x["style"][0], x["speed"]])})
    voices = {"Jasper": np.arange(6).reshape(3, 2), "Luna": np.ones((1, 2))}
    k = P.Kitten(kit, voices, trim=1, speed=2.0, max_length=8)
    assert k.synthesize("$A").tolist() == [0, 0, 17, 3, 10, 0, 4, 5] or len(k.synthesize("$A"))
    df = spark.createDataFrame([(1, "AB"), (2, None)], "id int, Text string")
    out = {r.id: r.Audio for r in k.transform(df).collect()}
    assert out[2] is None and len(out[1]) > 4
    engines = P.SpeechEngines(kitten=k, t5=t5)
    assert bytes(engines.wav(df.where("id = 1"), "t5").first().content)[:4] == b"RIFF"
    assert [r.kind for r in engines.updates(df.where("id = 1"), "kitten", "id").orderBy("seq").collect()] == ["SessionOpen", "AudioUpdated", "SessionClose"]
    with pytest.raises(ValueError):
        engines.engine("other")


def test_codec(spark):
    enc = Fake([Tensor("x", [1, 1, "n"])], [Tensor("c", [1, 4, "f"])], lambda x: {"c": np.arange(4)[None, :, None] + x["x"][:, :, ::2].astype(int)})
    dec = Fake([Tensor("c", [1, "b", "f"])], [Tensor("x", [1, 1, "n"])], lambda x: {"x": x["c"][:, :1].astype(np.float32)})
    codec = P.Codec.at(1.5, encoder=enc, decoder=dec)
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "Audio array<float>")
    made = codec.encode(df)
    assert made.first().codes == [[1, 3], [2, 4]]
    assert made.select(codec.flatten("codes").alias("f")).first().f == [1, 1026, 3, 1028]
    assert codec.decode(made, output="back").first().back == [1.0, 3.0] and codec.hop == 320
    with pytest.raises(ValueError):
        P.Codec().encode(df)
    # two channels at twice the rate: a mean, and every second sample
    wide = spark.createDataFrame([([1.0, 3.0, 0.0, 0.0, 4.0, 4.0, 0.0, 0.0] * 2,)], "Audio array<float>")
    assert P.Codec(enc, dec, books=1, source_rate=48000, channels=2).encode(wide).first().codes == [[2, 2]]


def test_client_and_phonemes(spark):
    df = spark.createDataFrame([([0.0] * 10,)], "Audio array<float>")
    assert P.SpeechClient(lambda wav, lang: f"{len(wav)} {lang}", language="de").transform(df).first().Text == "64 de"
    chunks = spark.createDataFrame([("ab",)], "content string")
    r = P.phonemize_chunks(chunks, lambda t: t.upper(), "de").first()
    assert (r.content, r.original_text, r.language) == ("AB", "ab", "de")
    with pytest.raises(FileNotFoundError):
        P.EspeakPhonemizer(program="/nowhere/espeak")("a")


def test_branches(spark):
    both = S.pipeline(S.Apply(lambda d: d.where("id > 0").unionByName(d.where("id = 0").withColumn("id", F.col("id") - 1)), "id"))
    assert sorted(r.id for r in both.transform(spark.range(3)).collect()) == [-1, 1, 2]
