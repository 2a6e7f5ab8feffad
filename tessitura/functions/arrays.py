"""Column builders for signals, frames, scores and vectors.

All are built from higher-order functions, so they stay in the JVM and fuse with the
rest of a plan.  Arithmetic is in double.  They suit arrays of up to some ten thousand
elements; ``tessitura.sources.wav`` and ``tessitura.functions.mel`` do PCM-sized work on
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

def zero() -> Column:
    return F.lit(0.0)

LOG_FLOOR = 1e-10


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def indices(n: Column | int) -> Column:
    """0 .. n - 1, none if n is 0 or less (a bare ``sequence`` would count down)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def doubles(a: Column | str) -> Column:
    return _c(a).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, zero(), lambda s, x: s + x)


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE has it for 0 / 0: NaN."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)


# signals


def duration(samples: Column | str, rate: Column | int) -> Column:
    """Seconds of a signal: samples over rate, whatever the number of channels."""
    return F.size(_c(samples)) / F.lit(rate) if isinstance(rate, int) else F.size(_c(samples)) / rate


def resample_linear(samples: Column | str, source: int, target: int) -> Column:
    """Linear interpolation, without a filter; the same samples at the same rate."""
    a = doubles(samples)
    if source == target:
        return a
    step = source / target
    last = F.size(a) - 1

    def at(i: Column) -> Column:
        place = i * F.lit(step)
        low = F.floor(place).cast("int")
        part = place - low
        return F.get(a, low) * (1 - part) + F.get(a, F.least(low + 1, last)) * part

    return F.transform(indices(F.floor(F.size(a) / F.lit(step)).cast("int")), at)


def to_mono(samples: Column | str, channels: int) -> Column:
    """The mean over interleaved channels; samples that don't fill a frame are left out."""
    a = doubles(samples)
    if channels == 1:
        return a
    return F.transform(indices(F.floor(F.size(a) / channels).cast("int")), lambda i: total(F.slice(a, i * channels + 1, channels)) / channels)


def pcm16(x: Column) -> Column:
    """A sample as a 16-bit number: clamped, scaled and cut towards zero."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int")


def from_pcm16(x: Column) -> Column:
    return x / 32767.0


def peak_normalize(samples: Column | str) -> Column:
    """Divided by the largest magnitude if that is over 1."""
    a = doubles(samples)
    peak = F.array_max(F.transform(a, F.abs))
    return F.when(peak > 1, F.transform(a, lambda x: x / peak)).otherwise(a)


def trim_end(samples: Column | str, n: int) -> Column:
    a = _c(samples)
    return F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - n))


def sine(n: int, rate: int, hertz: float, amplitude: float = 0.5) -> Column:
    return F.transform(indices(n), lambda i: F.sin(i * (2 * 3.141592653589793 * hertz / rate)) * amplitude)


def tones(n: int, rate: int, parts: Sequence[tuple[float, float]]) -> Column:
    """A sum of sines, each of (hertz, amplitude)."""
    turn = 2 * 3.141592653589793 / rate

    def at(i: Column) -> Column:
        out = zero()
        for hertz, amplitude in parts:
            out = out + F.sin(i * (turn * hertz)) * amplitude
        return out

    return F.transform(indices(n), at)


def chirp(n: int, rate: int, low: float = 200.0, rise: float = 1800.0, amplitude: float = 0.5) -> Column:
    """sin(2 pi f(t) t) with f(t) = low + rise * t / duration."""
    seconds = n / rate

    def at(i: Column) -> Column:
        t = i / F.lit(float(rate))
        return F.sin(2 * 3.141592653589793 * (low + rise * t / seconds) * t) * amplitude

    return F.transform(indices(n), at)


def noise(n: int, key: Column, amplitude: float = 0.3) -> Column:
    """Evenly spread numbers between -amplitude and amplitude, the same for the same key."""
    unit = lambda i: F.pmod(F.xxhash64(key, i), F.lit(1 << 40)) / float(1 << 40)
    return F.transform(indices(n), lambda i: (unit(i) * 2 - 1) * amplitude)


# frames


def log_floor(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(LOG_FLOOR)))


def fit_frames(features: Column | str, dim: int, expected: int) -> tuple[Column, Column]:
    """(features cut or padded with zeros to ``expected`` frames, whether there were more)."""
    a = doubles(features)
    n = expected * dim
    fitted = F.concat(F.slice(a, 1, n), F.array_repeat(zero(), F.greatest(F.lit(0), F.lit(n) - F.size(a))))
    return fitted, F.floor(F.size(a) / dim) > expected


def whisper_frames(frames: Column | str, bins: int, expected: int = 3000, pad: float = 0.0, padded: bool = True) -> Column:
    """Rows of ``bins`` values, cut to ``expected`` of them and, if asked for, padded to as many."""
    a = _c(frames)
    head = F.slice(a, 1, expected)
    if not padded:
        return head
    return F.concat(head, F.array_repeat(F.array_repeat(F.lit(pad), bins), F.greatest(F.lit(0), F.lit(expected) - F.size(a))))


def infer_shape(features: Column | str, dims: Sequence[int]) -> Column:
    """struct(frames, dim) of a flat feature vector for a model input of these dimensions; -1 is unknown."""
    size = F.size(_c(features))
    last = dims[-1] if len(dims) in (3, 4) and dims[-1] > 0 else 80
    if len(dims) not in (3, 4):
        return F.struct(F.lit(1).alias("frames"), size.alias("dim"))
    return F.struct(F.floor(size / last).cast("int").alias("frames"), F.lit(last).alias("dim"))


def rows_of(flat: Column | str, dim: int) -> Column:
    """A flat row-major matrix as an array of rows."""
    a = doubles(flat)
    return F.transform(indices(F.floor(F.size(a) / dim).cast("int")), lambda i: F.slice(a, i * dim + 1, dim))


def flatten_rows(rows: Column | str) -> Column:
    return F.flatten(_c(rows))


def transpose(rows: Column | str, dim: int) -> Column:
    a = _c(rows)
    return F.transform(indices(dim), lambda j: F.transform(a, lambda r: F.get(r, j)))


# scores


def softmax(scores: Column | str) -> Column:
    a = doubles(scores)
    top = F.array_max(a)
    return _shares(F.transform(a, lambda x: F.exp(x - top)))


def _shares(e: Column) -> Column:
    """e over its sum, which is made once: the array and the sum travel in one struct."""
    both = F.struct(e.alias("e"), total(e).alias("s"))
    return F.get(F.transform(F.array(both), lambda b: F.transform(b["e"], lambda x: x / b["s"])), F.lit(0))


def argmax(scores: Column | str) -> Column:
    """Index of the first largest score; null for an empty array."""
    a = _c(scores)
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)).cast("int") - 1)


def label_lookup(labels: Sequence[str], index: Column) -> Column:
    """The label, or ``Class_<index>`` where there is none."""
    return F.coalesce(F.get(F.array(*(F.lit(x) for x in labels)), index) if labels else F.lit(None).cast("string"), F.concat(F.lit("Class_"), index.cast("string")))


def top_k(scores: Column | str, k: int) -> Column:
    """The k largest scores as array<struct<rank, index, score>>; equal ones by index."""
    order = F.array_sort(F.transform(doubles(scores), lambda x, i: F.struct((-x).alias("key"), i.alias("index"))))
    return F.transform(F.slice(order, 1, k), lambda s, r: F.struct((r + 1).alias("rank"), s["index"].alias("index"), (-s["key"]).alias("score")))


def sample_token(scores: Column | str, u: Column, temperature: float) -> Column:
    """The token that a number u in [0, 1) draws from softmax(scores / temperature); the best one at 0."""
    if temperature <= 0:
        return argmax(scores)
    p = softmax(F.transform(doubles(scores), lambda x: x / temperature))
    start = F.struct(zero().alias("sum"), F.lit(-1).alias("found"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        sum_ = s["sum"] + x
        return F.struct(sum_.alias("sum"), F.when((s["found"] < 0) & (sum_ >= u), s["at"]).otherwise(s["found"]).alias("found"), (s["at"] + 1).alias("at"))

    return F.aggregate(p, start, step, lambda s: F.when(s["found"] < 0, s["at"] - 1).otherwise(s["found"]))


# pooling and vectors


def _strided(a: Column, hidden: int, d: Column) -> Column:
    return F.transform(indices(F.floor(F.size(a) / hidden).cast("int")), lambda t: F.get(a, t * hidden + d))


def mean_pool(states: Column | str, hidden: int) -> Column:
    """The mean over steps; NaN without steps."""
    a = doubles(states)
    steps = F.floor(F.size(a) / hidden).cast("double")
    return F.transform(indices(hidden), lambda d: ratio(total(_strided(a, hidden, d)), steps))


def max_pool(states: Column | str, hidden: int) -> Column:
    """The largest over steps; the least float without steps."""
    a = doubles(states)
    return F.transform(indices(hidden), lambda d: F.coalesce(F.array_max(_strided(a, hidden, d)), F.lit(-3.4028234663852886e38)))


def cls_pool(states: Column | str, hidden: int) -> Column:
    return F.slice(doubles(states), 1, hidden)


def pool(states: Column | str, hidden: int, strategy: str = "mean", pooled: bool = False) -> Column:
    """By strategy (mean, max, cls; any other is mean); as it is if it was pooled before or has no dimension."""
    if pooled or hidden <= 0:
        return doubles(states)
    return {"max": max_pool, "cls": cls_pool}.get(strategy, mean_pool)(states, hidden)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, zero(), lambda s, x: s + x * x))


def l2_normalize(vector: Column | str) -> Column:
    a = doubles(vector)
    both = F.struct(a.alias("a"), norm(a).alias("n"))
    return F.get(F.transform(F.array(both), lambda b: F.when(b["n"] > 0, F.transform(b["a"], lambda x: x / b["n"])).otherwise(b["a"])), F.lit(0))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    x, y = doubles(a), doubles(b)
    return ratio(total(F.zip_with(x, y, lambda p, q: p * q)), norm(x) * norm(y))


# codec tokens


def codec_flatten(codes: Column | str, size: int) -> Column:
    """Codes by codebook to one list, frame by frame, each codebook in a range of its own."""
    a = _c(codes)
    frames = F.size(F.get(a, F.lit(0)))
    return F.flatten(F.transform(indices(frames), lambda f: F.transform(a, lambda book, c: F.get(book, f) + c * size)))


def codec_vocab_size(books: int, size: int) -> int:
    return books * size


def codec_frame_count(seconds: Column, rate: int, hop: int) -> Column:
    return F.floor((seconds * rate).cast("int") / hop).cast("int")


def dft_power(samples: Column | str, n: int) -> Column:
    """|DFT|^2 of n samples for the frequencies 0 .. n / 2, by explicit sums: for short frames."""
    a = doubles(samples)
    turn = 2 * 3.141592653589793 / n

    def power(k: Column) -> Column:
        re = total(F.transform(a, lambda x, i: x * F.cos(k * i * turn)))
        im = total(F.transform(a, lambda x, i: x * F.sin(k * i * turn)))
        return re * re + im * im

    return F.transform(indices(n // 2 + 1), power)
