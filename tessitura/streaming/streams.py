"""Incremental forms: files as they arrive, events in windows, and voice activity over a stream of frames.

Watermarks bound the state of windows; voice activity keeps one small record for each
stream, and a timer closes the segment of a stream that has gone quiet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessitura.operators import segment
from tessitura.sources.wav import decode_wav

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_wav(spark: SparkSession, path: str, rate: int = 16000, glob: str = "*.wav", files_per_trigger: int = 100) -> DataFrame:
    """path, modificationTime and audio of files as they appear below path; what can't be read has null audio."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select("path", "modificationTime", decode_wav("content", rate, errors="null").alias("audio"))


def stream_segments(audio: DataFrame, rate: int = 16000, seconds: float = 2.0) -> DataFrame:
    """Segments of the files of stream_wav; no state is kept."""
    own = audio.where("audio is not null").select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.col("audio.samples").alias("samples"))
    return segment.segment_audio(own, "samples", rate, seconds).select("source_file", "segment_index", "start_sec", "end_sec", "content")


def event_time(events: DataFrame, column: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Events with a watermark; a time without a zone is taken as one of the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def tumbling(events: DataFrame, keys: list[str], size: str = "1 hour", slide: str | None = None, value: str = "value") -> DataFrame:
    """Counts and sums of value in windows; sliding ones if they begin more often than they are long."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "1 hour", value: str = "value") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n", "total")


SEGMENTS = "key string, start_frame long, end_frame long, confidence double"
STATE = "start long, last long, sum double, n long, tail_sum double, tail_n long, next long"
_NEW = (-1, -1, 0.0, 0, 0.0, 0, 0)


def step(state: tuple, probs: list[float], threshold: float, gap: int) -> tuple[tuple, list[tuple[int, int, float]]]:
    """(state, segments closed) after more frames.

    state: start and last speech frame of the open segment (-1: none), sum and number of its
    probabilities up to the last speech frame, those of the silence since, the next frame.
    """
    start, last, total, n, tail, tail_n, at = state
    closed = []
    for p in probs:
        if p >= threshold:
            if start < 0:
                start, total, n = at, 0.0, 0
            total, n, last, tail, tail_n = total + tail + p, n + tail_n + 1, at, 0.0, 0
        elif start >= 0:
            tail, tail_n = tail + p, tail_n + 1
            if tail_n >= gap:
                closed.append((start, last, total / n))
                start, last, total, n, tail, tail_n = -1, -1, 0.0, 0, 0.0, 0
        at += 1
    return (start, last, total, n, tail, tail_n, at), closed


def finish(state: tuple) -> list[tuple[int, int, float]]:
    """The segment that is open at the end of a stream; it has the silence after it, too short to end it."""
    start, _, total, n, tail, tail_n, at = state
    return [(start, at - 1, (total + tail) / (n + tail_n))] if start >= 0 else []


class SpeechProcessor(StatefulProcessor):
    """Frames of a stream (key, frame, prob) to its speech segments, as they close.

    A stream's frames must come in order over batches; within a batch they are sorted.
    After ``idle`` milliseconds without frames the stream has ended.
    """

    def __init__(self, threshold: float = 0.5, gap: int = 4, idle: int = 60_000):
        self.threshold, self.gap, self.idle = threshold, gap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("speech", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else _NEW
        frames = pd.concat(list(rows)).sort_values("frame")
        state, closed = step(state, frames["prob"].tolist(), self.threshold, self.gap)
        self.state.update(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = finish(tuple(self.state.get())) if self.state.exists() else []
        self.state.clear()
        yield self._rows(key, closed)

    @staticmethod
    def _rows(key, closed) -> pd.DataFrame:
        return pd.DataFrame([(str(key[0]), a, b, c) for a, b, c in closed], columns=["key", "start_frame", "end_frame", "confidence"])

    def close(self) -> None:
        pass


def stream_speech(frames: DataFrame, key: str, threshold: float = 0.5, gap: int = 4, idle: int = 60_000) -> DataFrame:
    """Speech segments of streams of (key, frame, prob); needs the RocksDB state store."""
    return frames.groupBy(key).transformWithStateInPandas(SpeechProcessor(threshold, gap, idle), SEGMENTS, "Append", "ProcessingTime")
