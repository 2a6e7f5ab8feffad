"""Counts of all words of a corpus, by packed exchange."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessitura.llm.blocks import PACKED, chunks, runs, scatter

U = np.uint64
FLUSH = 1_000_000  # distinct words that a task holds before it sends them on


def merged(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the sums of their counts."""
    order = np.argsort(h)
    h, counts = h[order], counts[order]
    begins, _ = runs(h)
    return h[begins], np.add.reduceat(counts, begins) if len(begins) else counts


class Counter:
    """Sums counts of hashes in bounded memory: hands out what it holds when that is much."""

    def __init__(self):
        self.h, self.c = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        self.size = 0

    def add(self, h: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.h.append(h)
        self.c.append(c)
        self.size += len(h)
        if self.size > 2 * FLUSH:
            h, c = merged(np.concatenate(self.h), np.concatenate(self.c))
            if len(h) > FLUSH:
                yield h, c
                h, c = h[:0], c[:0]
            self.h, self.c, self.size = [h], [c], len(h)

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(np.concatenate(self.h), np.concatenate(self.c))


def packed_counts(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], n: int) -> DataFrame:
    """docs to packed (h, c): what ``hashes`` gives for each batch, counted by task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in chunks(batches):
            h, c = np.unique(hashes(batch), return_counts=True)
            for found in counter.add(h, c):
                yield scatter(found[0], {"h": found[0], "c": found[1]}, n)
        h, c = counter.rest()
        if len(h):
            yield scatter(h, {"h": h, "c": c}, n)

    return docs.mapInArrow(count, PACKED)
