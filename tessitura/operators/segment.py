"""Row generators: pieces of signals, one row for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.arrays import indices


def _pieces(df: DataFrame, samples: str, offsets: Column, window: int, index: str) -> DataFrame:
    rows = df.select("*", F.posexplode(offsets).alias(index, "offset"))
    return rows.withColumn("content", F.expr(f"slice(`{samples}`, offset + 1, {window})"))


def segment_audio(df: DataFrame, samples: str, rate: int, seconds: float = 2.0) -> DataFrame:
    """Windows of equal length, one after the other; the last one may be short.

    Adds segment_index, offset, content, start_sec and end_sec.
    """
    window = int(seconds * rate)
    if window <= 0:
        raise ValueError("a segment needs at least one sample")
    n = F.size(samples)
    out = _pieces(df, samples, F.transform(indices(F.ceil(n / window).cast("int")), lambda i: i * window), window, "segment_index")
    return out.withColumn("start_sec", F.col("offset") / F.lit(float(rate))).withColumn("end_sec", (F.col("offset") + F.size("content")) / F.lit(float(rate)))


def chunk_overlapped(df: DataFrame, samples: str, window: int, overlap: int = 0) -> DataFrame:
    """Windows that share ``overlap`` samples with the next one, up to the first short one.

    Adds chunk_index, offset and content.
    """
    step = window - overlap
    if step <= 0:
        raise ValueError("windows must begin later than the ones before them")
    n = F.size(samples)
    starts = F.transform(indices(F.ceil(n / step).cast("int")), lambda i: i * step)
    return _pieces(df, samples, F.filter(starts, lambda o: (o == 0) | (o - step + window <= n)), window, "chunk_index")


def frame_windows(df: DataFrame, samples: str, window: int) -> DataFrame:
    """Full windows, one after the other; what is left over at the end is dropped.  Adds frame, offset and content."""
    n = F.floor(F.size(samples) / window).cast("int")
    return _pieces(df, samples, F.transform(indices(n), lambda i: i * window), window, "frame")


def concat_audio(pieces: DataFrame, key: str, index: str, content: str) -> DataFrame:
    """The pieces of each key joined in order: key, samples."""
    own = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(content).alias("a"))))
    return pieces.groupBy(key).agg(F.flatten(F.transform(own, lambda p: p["a"])).alias("samples"))
