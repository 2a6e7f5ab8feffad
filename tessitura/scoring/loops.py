"""Models that run step by step: voice activity, recognition, synthesis, codecs.

Every loop runs within one row; its state is local.  Sessions are anything with
``get_inputs``, ``get_outputs`` and ``run``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from tessitura.scoring.sessions import Session, input_type

# voice activity


def speech_probabilities(session: Session, samples: np.ndarray, rate: int = 16000, window: int = 512, state: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(probability of speech in each full window, the state after the last one).

    The model's inputs are the window, the rate and one state or more; states are the
    inputs after these two and come back as the outputs after the first, in order.
    """
    inputs = list(session.get_inputs())
    audio = next((x.name for x in inputs if x.name == "input"), inputs[0].name)
    sr = next((x.name for x in inputs if x.name == "sr"), None)
    carried = [x for x in inputs if x.name not in (audio, sr)]
    if state is None:
        shape = lambda x: [d if isinstance(d, int) and d > 0 else 1 for d in x.shape]
        state = {x.name: np.zeros(shape(x), np.float32) for x in carried}
    out = np.empty(len(samples) // window, np.float32)
    for i in range(len(out)):
        feeds = {audio: np.asarray(samples[i * window : (i + 1) * window], np.float32)[None], **state}
        if sr:
            feeds[sr] = np.array([rate], input_type(session, sr))
        probability, *after = session.run(None, feeds)
        out[i] = np.asarray(probability).ravel()[0]
        state = {x.name: a for x, a in zip(carried, after, strict=False)}
    return out, state


# keys and values of attention


@dataclass
class KeyValueCache:
    """What a decoder keeps between steps: its own part grows, the encoder's is kept from the first step on."""

    layers: int
    heads: int
    dim: int
    own: dict[str, np.ndarray] = field(default_factory=dict)
    cross: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, session: Session, layers: int = 0, heads: int = 0, dim: int = 64) -> KeyValueCache:
        """Sizes by the names and shapes of a decoder's inputs, where they aren't given."""
        inputs = {x.name: x for x in session.get_inputs()}
        if layers <= 0:
            while f"past_key_values.{layers}.decoder.key" in inputs:
                layers += 1
        if (first := inputs.get("past_key_values.0.decoder.key")) is not None and len(first.shape) == 4:
            known = lambda x, other: x if isinstance(x, int) and x > 0 else other
            heads, dim = heads if heads > 0 else known(first.shape[1], 1), known(first.shape[3], dim)
        return cls(layers, max(1, heads), dim)

    def __bool__(self) -> bool:
        return bool(self.own)

    def feeds(self) -> dict[str, np.ndarray]:
        none = np.zeros((1, self.heads, 0, self.dim), np.float32)
        names = [(i, side, kind) for i in range(self.layers) for side in ("decoder", "encoder") for kind in ("key", "value")]
        return {f"past_key_values.{i}.{side}.{kind}": (self.own if side == "decoder" else self.cross).get(f"{i}.{side}.{kind}", none) for i, side, kind in names}

    def update(self, outputs: dict[str, np.ndarray]) -> None:
        first = not self.cross
        for i in range(self.layers):
            for kind in ("key", "value"):
                for side, kept in (("decoder", self.own), ("encoder", self.cross)):
                    name = f"{i}.{side}.{kind}"
                    if f"present.{name}" in outputs and (side == "decoder" or first):
                        kept[name] = outputs[f"present.{name}"]

    def reset(self) -> None:
        self.own, self.cross = {}, {}


def _run(session: Session, feeds: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    takes = {x.name for x in session.get_inputs()}
    names = [x.name for x in session.get_outputs()]
    return dict(zip(names, session.run(names, {k: v for k, v in feeds.items() if k in takes}), strict=True))


# recognition


def sample(logits: np.ndarray, temperature: float, rng: np.random.Generator) -> int:
    """The best token at temperature 0, else one drawn from the softmax of logits / temperature."""
    if temperature <= 0:
        return int(np.argmax(logits))
    z = np.asarray(logits, float) / temperature
    p = np.exp(z - z.max())
    at = int(np.searchsorted(np.cumsum(p / p.sum()), rng.random()))
    return min(at, len(p) - 1)


def encode_speech(encoder: Session, features: np.ndarray) -> np.ndarray:
    """(frames, bins) to the encoder's (1, steps, hidden)."""
    names = [x.name for x in encoder.get_inputs()]
    name = "input_features" if "input_features" in names else names[0]
    return encoder.run(None, {name: np.ascontiguousarray(np.asarray(features, np.float32).T)[None]})[0]


def transcribe(
    encoder: Session, decoder: Session, features: np.ndarray, prompt: Sequence[int], end: int,
    most: int = 256, temperature: float = 0.0, seed: int = 0, with_prompt: bool = True, layers: int = 0, heads: int = 0,
) -> list[int]:
    """Token ids: the prompt and what the decoder adds to it, up to ``most`` steps or the end token."""
    hidden = encode_speech(encoder, features)
    cache = KeyValueCache.of(decoder, layers, heads)
    rng = np.random.default_rng(seed)
    ids, now = list(prompt), list(prompt)
    for _ in range(most):
        feeds = {"input_ids": np.array([now], np.int64), "encoder_hidden_states": hidden, "use_cache_branch": np.array([bool(cache)]), **cache.feeds()}
        out = _run(decoder, feeds)
        logits = out.get("logits", next(iter(out.values())))
        token = sample(logits[0, -1], temperature, rng)
        if token == end:
            break
        ids.append(token)
        cache.update(out)
        # without a cache the decoder needs all tokens again
        now = [token] if cache else ids
    return ids if with_prompt else ids[len(prompt) :]


# synthesis


def peak_normalize(x: np.ndarray) -> np.ndarray:
    peak = float(np.abs(x).max()) if len(x) else 0.0
    return x / peak if peak > 1 else x


def speecht5(
    encoder: Session, decoder: Session, vocoder: Session, ids: Sequence[int], speaker: np.ndarray,
    bins: int = 80, most: int = 1000, stop: float = 0.5,
) -> np.ndarray:
    """Samples of a text's ids: encoder, mel frames one by one, vocoder, peak normalisation."""
    mask = np.ones((1, len(ids)), np.int64)
    hidden = next(iter(_run(encoder, {"input_ids": np.array([ids], np.int64), "attention_mask": mask}).values()))
    cache = KeyValueCache.of(decoder)
    frame, frames = np.zeros(bins, np.float32), []
    for step in range(most):
        out = _run(decoder, {
            "output_sequence": frame[None, None], "encoder_hidden_states": hidden, "encoder_attention_mask": mask,
            "speaker_embeddings": np.asarray(speaker, np.float32)[None], "use_cache_branch": np.array([bool(cache)]), **cache.feeds(),
        })
        sequence = np.asarray(out.get("output_sequence_out", next(iter(out.values()))), np.float32)
        frame = sequence[0, -1, :bins] if sequence.ndim >= 3 else sequence[0, :bins]
        frames.append(frame)
        if "prob" in out and out["prob"].size and float(np.ravel(out["prob"])[-1]) > stop and step > 0:
            break
        cache.update(out)
    mel = np.stack(frames) if frames else np.zeros((0, bins), np.float32)
    first = vocoder.get_inputs()[0]
    samples = vocoder.run(None, {first.name: mel if len(first.shape) == 2 else mel[None]})[0]
    return peak_normalize(np.asarray(samples, np.float32).ravel())


def kitten_chunk(session: Session, ids: Sequence[int], style: np.ndarray, speed: float = 1.0, trim: int = 5000) -> np.ndarray:
    """Samples of one chunk's phoneme ids, less ``trim`` at the end."""
    framed = np.array([[0, *ids, 10, 0]], np.int64)
    out = session.run(None, {"input_ids": framed, "style": np.asarray(style, np.float32)[None], "speed": np.array([speed], np.float32)})[0]
    x = np.asarray(out, np.float32).ravel()
    return x[: len(x) - min(trim, len(x))]


def kitten(
    session: Session, chunks: Sequence[str], encode: Callable[[str], Sequence[int]], voices: dict[str, np.ndarray], voice: str,
    speed: float = 1.0, trim: int = 5000, phonemize: Callable[[str], str] | None = None,
) -> np.ndarray:
    """Samples of a text's chunks, joined.  An unknown voice is the first one; the style goes by a chunk's length."""
    table = voices[voice if voice in voices else next(iter(voices))]
    parts = []
    for chunk in chunks:
        phonemes = phonemize(chunk) if phonemize else chunk
        style = table[min(len(chunk.encode("utf-16-le")) // 2, len(table) - 1)]
        parts.append(kitten_chunk(session, encode(phonemes), style, speed, trim))
    return np.concatenate([np.zeros(0, np.float32), *parts])


# codecs

#: Codebooks of the codec by its bandwidth in kbps.
CODEBOOKS = {1.5: 2, 3.0: 4, 6.0: 8, 12.0: 16, 24.0: 32}


def codec_hop(rate: int) -> int:
    return 320 if rate == 24000 else 640


def codec_encode(session: Session | None, samples: np.ndarray, books: int) -> np.ndarray:
    """(books, frames) of codes, of the first codebooks."""
    if session is None:
        raise ValueError("encoding needs an encoder model")
    codes = session.run(None, {session.get_inputs()[0].name: np.asarray(samples, np.float32)[None, None]})[0]
    return np.asarray(codes, np.int64).reshape(codes.shape[-2], codes.shape[-1])[:books]


def codec_decode(session: Session | None, codes: np.ndarray) -> np.ndarray:
    if session is None:
        raise ValueError("decoding needs a decoder model")
    out = session.run(None, {session.get_inputs()[0].name: np.asarray(codes, np.int64)[None]})[0]
    return np.asarray(out, np.float32).ravel()
