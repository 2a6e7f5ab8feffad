"""Speech segments out of frame probabilities: gaps and islands by window functions.

A stream's frames are sorted once; all windows and the grouping share that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def silence_frames(min_silence: float, frame: float) -> int:
    """How many silent frames end a segment: the least number that lasts as long."""
    return max(1, ceil(min_silence / frame - 1e-9))


def speech_islands(frames: DataFrame, key: str, frame: str, prob: str, threshold: float = 0.5, gap: int = 4) -> DataFrame:
    """frames(key, frame 0.., prob) to key, island, start_frame, end_frame, n_frames, confidence.

    A frame of at least the threshold opens an island; ``gap`` silent frames close it at
    its last speech frame.  Shorter gaps belong to it, and so does a shorter silence at the
    end of the stream.  Confidence is the mean probability of all its frames.
    """
    order = Window.partitionBy(key).orderBy(frame)
    speech = F.col(prob) >= threshold
    spoken = F.when(speech, F.col(frame))
    before = F.max(spoken).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = speech & (before.isNull() | (F.col(frame) - before - 1 >= gap))
    marked = (
        frames.select(key, frame, prob)
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
        .withColumn("_spoken", spoken)
        .withColumn("_opens", opens.cast("int"))
        .withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where("island > 0")
        .withColumn("_last", F.max("_spoken").over(Window.partitionBy(key, "island")))
    )
    tail = F.col("_n") - 1 - F.col("_last")
    end = F.when((tail >= 1) & (tail < gap), F.col("_n") - 1).otherwise(F.col("_last"))
    own = marked.withColumn("_end", end).where(F.col(frame) <= F.col("_end"))
    return own.groupBy(key, "island").agg(
        F.min(frame).alias("start_frame"), F.max("_end").alias("end_frame"), F.max("_n").alias("n_frames"), F.avg(prob).alias("confidence")
    )


def speech_segments(
    frames: DataFrame, key: str, frame: str, prob: str, frame_seconds: float = 0.032,
    threshold: float = 0.5, min_speech: float = 0.25, min_silence: float = 0.1, pad: float = 0.03,
) -> DataFrame:
    """key, start, end, confidence of the speech of each stream, in seconds.

    Segments are padded on both sides within the stream and dropped if they are still
    shorter than min_speech.  Padded neighbours may overlap.
    """
    islands = speech_islands(frames, key, frame, prob, threshold, silence_frames(min_silence, frame_seconds))
    start = F.greatest(F.lit(0.0), F.col("start_frame") * frame_seconds - pad)
    end = F.least(F.col("n_frames") * F.lit(frame_seconds), (F.col("end_frame") + 1) * frame_seconds + pad)
    # times are whole ticks of 100 ns, as durations are compared
    return islands.select(key, "island", F.round(start, 7).alias("start"), F.round(end, 7).alias("end"), "confidence").where(F.round(F.col("end") - F.col("start"), 7) >= min_speech)


def cut_segments(
    probs: Sequence[float], frame_seconds: float = 0.032, threshold: float = 0.5, min_speech: float = 0.25, min_silence: float = 0.1, pad: float = 0.03,
) -> list[tuple[int, float, float, float]]:
    """(island, start, end, confidence) of one stream in memory: what speech_segments gives for its frames."""
    gap, n = silence_frames(min_silence, frame_seconds), len(probs)
    p = np.asarray(probs, float)
    spoken = np.flatnonzero(p >= threshold)
    if not len(spoken):
        return []
    cuts = np.flatnonzero(np.diff(spoken) - 1 >= gap)
    firsts, lasts = spoken[np.concatenate([[0], cuts + 1])], spoken[np.concatenate([cuts, [len(spoken) - 1]])]
    out = []
    for island, (a, b) in enumerate(zip(firsts.tolist(), lasts.tolist(), strict=True), 1):
        b = n - 1 if 1 <= n - 1 - b < gap else b
        start, end = round(max(0.0, a * frame_seconds - pad), 7), round(min(n * frame_seconds, (b + 1) * frame_seconds + pad), 7)
        if round(end - start, 7) >= min_speech:
            out.append((island, start, end, float(p[a : b + 1].mean())))
    return out


def speech_summary(streams: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """One row for each stream, silent ones too: SegmentCount, TotalSpeechSeconds, SegmentStarts, SegmentEnds, SegmentConfidences."""
    own = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "confidence"))).alias("s"), F.sum(F.col("end") - F.col("start")).alias("t"))
    none = F.array().cast("array<double>")
    part = lambda name: F.coalesce(F.col(f"s.{name}"), none)
    return streams.select(key).distinct().join(own, key, "left").select(
        key, F.when(F.col("s").isNull(), 0).otherwise(F.size("s")).alias("SegmentCount"),
        F.coalesce("t", F.lit(0.0)).alias("TotalSpeechSeconds"),
        part("start").alias("SegmentStarts"), part("end").alias("SegmentEnds"), part("confidence").alias("SegmentConfidences"),
    )


def speech_chunks(audio: DataFrame, segments: DataFrame, key: str, samples: str, rate: int) -> DataFrame:
    """The samples of each segment: one row for each, with start, end and confidence."""
    joined = audio.join(segments, key)
    first, last = F.floor(F.col("start") * rate).cast("int"), F.floor(F.col("end") * rate).cast("int")
    return joined.withColumn("content", F.slice(samples, first + 1, last - first))
