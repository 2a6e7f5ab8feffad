"""Vectorised text kernels and packed exchanges that the llm operators share.

Texts arrive as Arrow string arrays.  A kernel looks at the raw UTF-8 bytes with
numpy, so that no Python object is made for a word.  Words are the maximal runs of
characters other than U+0020 and U+0009 to U+000D; these separators are single
bytes in UTF-8 and never part of another character, so bytes are enough.

A *packed exchange* moves millions of small records between tasks as a few rows of
``(bucket int, payload binary)``: the sender splits its numpy columns by bucket and
the receiver joins them again.  The JVM then moves bytes and not rows.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # text looked at at once, unless one document is longer
_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_R, -1, 1 << 64)

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LETTERS = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_LETTERS[SEPARATORS] = 0
_FOLDED[SEPARATORS] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _CACHE or len(_CACHE[base]) < n:
        made = _powers(base, max(n, 1 << 16))
        if len(made) > 1 << 21:
            return made
        _CACHE[base] = made
    return _CACHE[base][:n]


@dataclass
class Words:
    """The words of a run of documents.

    ``raw``: their bytes; ``starts``/``ends``: of each word in raw; ``doc``: the
    document of each word, counted from 0; ``first``: the first word of each document
    and, at last, the number of words; ``offsets``: where each text begins in raw.
    """

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    separators: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash of each word; fold lower-cases A-Z."""
        table, n = (_FOLDED if fold else _LETTERS), len(self.starts)
        if self.separators is not None:
            table = np.where(self.separators, _U(0), table)
        out = np.empty(n, _U)
        at = 0
        while at < n:
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + CHUNK_BYTES, "right")))
            end = self.ends[to - 1]
            own = self.starts[at:to] - begin
            values = table[self.raw[begin:end]]
            values *= powers(_R, end - begin)
            sums = np.add.reduceat(values, own)
            # bytes between two words are separators and count 0, or there are none
            sums *= powers(_INVERSE, end - begin)[own]
            out[at:to] = sums + (self.ends[at:to] - self.starts[at:to]).astype(_U) * _U(0xA24BAED4963EE407)
            at = to
        return mix(out)

    def window_hashes(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of every run of k words of one document."""
        n = len(h)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        if k <= 4:
            out = np.zeros(len(at), _U)
            for j in range(k):
                out = mix(out * _U(0x9FB21C651E98DF25) + h[at + j])
            return at, out
        sums = np.zeros(n + 1, _U)
        np.cumsum(h * powers(_R, n), out=sums[1:])
        return at, mix((sums[at + k] - sums[at]) * powers(_INVERSE, n)[at])


def tokenise(texts: pa.Array, separators: np.ndarray = SEPARATORS) -> Words:
    """The words of all texts; a null is a text without words.

    Other ASCII characters may be separators too.
    """
    raw, offsets = text_bytes(texts)
    n = len(raw)
    word = ~separators[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    return Words(raw, offsets, starts, ends, doc, first, None if separators is SEPARATORS else separators)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind, width = np.int64, 8
    else:
        texts, kind, width = texts.cast(pa.string()), np.int32, 4
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``size`` bytes of text, or one document."""
    for batch in batches:
        lengths = np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1])
        total, at = np.cumsum(lengths), 0
        while at < len(lengths):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of one length as bytes: a head of names and types, then the arrays."""
    head = ";".join(f"{k}:{v.dtype.str}" for k, v in columns.items()).encode()
    n = len(next(iter(columns.values())))
    return b"".join([np.array([len(head), n], "<u4").tobytes(), head, *(np.ascontiguousarray(v).tobytes() for v in columns.values())])


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    size, n = (int(x) for x in np.frombuffer(payload, "<u4", 2))
    at, out = 8 + size, {}
    for part in bytes(payload[8 : 8 + size]).decode().split(";"):
        name, kind = part.split(":", 1)
        out[name] = np.frombuffer(payload, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


PACKED = "bucket int, payload binary"


def scatter(keys: np.ndarray, columns: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
    """One row for each bucket of keys (uint64 hashes) with its records."""
    bucket = (mix(keys) >> _U(33)) % _U(n)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    sizes = np.bincount(bucket.astype(np.int64), minlength=n)
    ends = np.cumsum(sizes)
    sorted_columns = {k: v[order] for k, v in columns.items()}
    used = np.flatnonzero(sizes)
    payloads = [pack({k: v[ends[b] - sizes[b] : ends[b]] for k, v in sorted_columns.items()}) for b in used]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places begins[i] .. begins[i] + lengths[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def scatter_ragged(keys: np.ndarray, columns: dict[str, np.ndarray], begins: np.ndarray, lengths: np.ndarray, flat: np.ndarray, n: int) -> pa.RecordBatch:
    """scatter() of records that each have a slice of flat besides; the slices follow the packed columns."""
    rows = scatter(keys, columns | {"_at": np.arange(len(keys))}, n)
    payloads = []
    for p in rows.column(1):
        own = unpack(p.as_buffer())
        at = own.pop("_at")
        payloads.append(pack(own) + flat[ragged(begins[at], lengths[at])].tobytes())
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def gather_ragged(batches: Iterator[pa.RecordBatch], schema: dict[str, str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All records that a task has received, and their slices of uint64 one after the other."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in schema}
    flat = [np.zeros(0, _U)]
    for batch in batches:
        for payload in batch.column(batch.schema.get_field_index("payload")):
            raw = payload.as_buffer()
            own = unpack(raw)
            head = 8 + int(np.frombuffer(raw, "<u4", 1)[0]) + sum(v.nbytes for v in own.values())
            flat.append(np.frombuffer(raw[head:], np.uint8).view("<u8") if len(raw) > head else flat[0])
            for k, v in own.items():
                parts[k].append(v)
    return {k: np.concatenate([np.zeros(0, schema[k]), *v]) for k, v in parts.items()}, np.concatenate(flat)


def gather(batches: Iterator[pa.RecordBatch], schema: dict[str, str]) -> dict[str, np.ndarray]:
    """All records that a task has received, in one array for each column."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in schema}
    for batch in batches:
        for payload in batch.column(batch.schema.get_field_index("payload")):
            for k, v in unpack(payload.as_buffer()).items():
                parts[k].append(v)
    return {k: np.concatenate([np.zeros(0, schema[k]), *v]) for k, v in parts.items()}


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which the worker gives back what it has freed: workers live on, and else each keeps the most that a task ever took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc's only
            ctypes.CDLL(None).malloc_trim(0)

    return run


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Within it, what is planned and run sends batches of this size to Python, and not of up to 64 MB, for which each task has buffers on either side."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


#: Partitions of an exchange; beyond that a task settles several buckets, one after the other.
PARTITIONS = 100_000


def exchange(df: DataFrame, n: int, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None, direct: bool = False) -> DataFrame:
    """Deals packed rows of n buckets out to tasks, which run f.

    f sees whole buckets.  Up to PARTITIONS buckets a task holds the few that hash to it at
    once, or with ``direct`` the one that has its number; where there are more, Spark sorts a
    task's rows by bucket, spilling to disk, and f
    runs on one bucket after the other, so that no task holds more than a bucket.
    """
    parts = parts or PARTITIONS
    dealt = df.repartitionById(n, F.col("bucket")) if direct and n <= parts else df.repartition(min(n, parts), "bucket")
    if n <= parts:
        return dealt.mapInArrow(f, schema)

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_cut_by_bucket(batches), key=lambda x: x[0]):
            yield from f(batch for _, batch in own)

    return dealt.sortWithinPartitions("bucket").mapInArrow(by_bucket, schema)


def _cut_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
        begins, counts = runs(bucket)
        for a, c in zip(begins.tolist(), counts.tolist(), strict=True):
            yield int(bucket[a]), batch.slice(a, c)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and how long it is."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return begins, np.diff(np.append(begins, len(sorted_keys)))


def sorted_sets(bounds: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each slice x[bounds[i]:bounds[i + 1]] in order, and their bounds."""
    x = x.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    keep[bounds[:-1][bounds[:-1] < len(x)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[bounds], x[keep]


#: From here on a planner's size is a default, and what a row is then taken to have.
UNKNOWN_SIZE, ROW_BYTES = 1 << 60, 4096


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 16) -> int:
    """A number of buckets in proportion to the size that the planner knows of df, without a limit."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= UNKNOWN_SIZE:  # rows of a driver or an RDD: the planner doesn't know
        size = df.count() * ROW_BYTES
    return max(least, size // bytes_each)


#: Keys, at most, that are broadcast because many rows have them.
HEAVY = 10_000


def join_by_count(rows: DataFrame, sums: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """rows with a struct ``__found`` of the columns of sums, which has each key once; null where there is none.

    ``count`` of sums says how many of the n rows, or more, have the key.  Keys of more than n / HEAVY rows, of
    which there are fewer than HEAVY, are broadcast, so that their rows don't meet in one task.
    """
    heavy = F.col(count) > max(1, n // HEAVY)
    found = F.struct(*(c for c in sums.columns if c != key))
    known = F.broadcast(sums.where(heavy).select(F.col(key).alias("__heavy"), found.alias("__found")))
    joined = rows.join(known, F.col(key) == F.col("__heavy"), "left").drop("__heavy")
    rest = joined.where("__found is null").drop("__found").join(sums.where(~heavy).select(key, found.alias("__found")), key, "left")
    return joined.where("__found is not null").unionByName(rest)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else, as in local tests, one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/tessitura-{os.getuid()}/checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a table of its own in the shared folder and read again.

    This cuts the lineage: the files outlive every executor.  Tables of a session are
    removed by whoever clears the shared folder, as with checkpoints.  Spark removes the shuffle
    files of what nothing refers to any more when the driver's memory is collected, so that is
    asked for: else those of all steps of a long job stay on the executors' disks.  The session
    holds on to its last query, hence the small one before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessitura-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a kept table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)
