"""Benchmark decontamination by pigeonhole edit matching (operator 3).

A document is contaminated by a test item if some run of its words is within ``rate`` of
the item's words in edit distance (words put in, left out or replaced).  Words are
compared in lower case (A-Z) and without ASCII punctuation, which separates words here.

An item of m words has a budget of k = floor(rate * m) errors (none if it has fewer than
``exact_below`` words, an option that is off) and is split into k + 1 pieces.  Where k errors or fewer fall on k + 1
pieces, one piece is whole: so every match holds one of the pieces unchanged.  All texts
are scanned for the pieces by rolling hashes, a bitmap ruling out nearly all places;
around each hit, Myers' bit-parallel algorithm gives the least distance of the item to
any run of words there.

The items go to all tasks in blocks of about BLOCK_BYTES of text, one scan for each
block; the documents are never shuffled.  Where there are several blocks, the result of each is
written and its block given up before the next one goes out.

Defined results: a null or empty text matches nothing; an item without words is passed
over; rows that repeat another match alike; a match of a document whose doc_id is null
has a null doc_id; repeated items match each under its own item_id; of several matches of an item in
one document the one of the least distance counts, the first of equal ones.  A text of any length is
scanned as a whole.  Of docs, only doc_id and text are read; ``drop_contaminated`` returns all
columns under their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.blocks import SEPARATORS, chunks, kept, mix, tokenise

U = np.uint64
RATE = 0.2
BLOCK_BYTES = 8 << 20
_SPLIT = SEPARATORS.copy()
_SPLIT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BITS = 20


def error_budget(m: int, rate: float, exact_below: int = 0) -> int:
    return 0 if m < exact_below else int(rate * m)


def myers(item: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """(least distance of the item to a run of words of text, words of text up to the end of the first such run).

    item: for each word a number with a bit for each of its places among the m words.
    """
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, end = m, 0
    for i, word in enumerate(text):
        same = item.get(word, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        plus = down | (mask & ~(across | up))
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up = minus | (mask & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


class ItemIndex:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, exact_below: int = 0):
        words = tokenise(pa.array([t for _, t in items], pa.string()), _SPLIT)
        h = words.hashes(fold=True)
        self.ids = [i for i, _ in items]
        self.words = [h[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        self.budgets = [error_budget(len(w), rate, exact_below) for w in self.words]
        self.places = []  # for each item the bits of its words
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (w, k) in enumerate(zip(self.words, self.budgets, strict=True)):
            bits: dict[int, int] = defaultdict(int)
            for j, x in enumerate(w.tolist()):
                bits[x] |= 1 << j
            self.places.append(dict(bits))
            cuts = [len(w) * j // (k + 1) for j in range(k + 2)] if len(w) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                found[b - a][int(run_hash(w[a:b], b - a)[0])].append((n, a))
        #: by length of piece: hashes in order, what they stand for, and a bitmap of their first bits
        self.pieces = {}
        for length, own in sorted(found.items()):
            keys = np.array(sorted(own), U)
            seen = np.zeros(1 << _BITS, bool)
            seen[(keys >> U(64 - _BITS)).astype(np.int64)] = True
            self.pieces[length] = (keys, [own[k] for k in keys.tolist()], seen)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, first word, end word, distance) of the best match of each row and item that match."""
        words = tokenise(texts, _SPLIT)
        h = words.hashes(fold=True)
        hits: dict[tuple[int, int], set[int]] = defaultdict(set)
        for length, (keys, own, seen) in self.pieces.items():
            grams = run_hash(h, length)
            at = np.flatnonzero(seen[(grams >> U(64 - _BITS)).astype(np.int64)])
            at = at[words.doc[at] == words.doc[at + length - 1]] if len(at) else at
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
            hit = keys[k] == grams[at]
            for place, key in zip(at[hit].tolist(), k[hit].tolist(), strict=True):
                for item, offset in own[key]:
                    hits[int(words.doc[place]), item].add(place - offset)
        out = []
        for (row, item), begins in hits.items():
            m, k = len(self.words[item]), self.budgets[item]
            low, high = int(words.first[row]), int(words.first[row + 1])
            best, regions = None, []
            for b in sorted(begins):  # regions that overlap are searched once
                a, e = max(low, b - k), min(high, b + m + k)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = max(e, regions[-1][1])
                else:
                    regions.append([a, e])
            for a, e in regions:
                distance, end = myers(self.places[item], m, h[a:e].tolist())
                if distance <= k and (best is None or distance < best[2]):
                    best = (max(a, a + end - m) - low, a + end - low, distance)
            if best:
                out.append((row, self.ids[item], *best))
        return out


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, across texts as well."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = mix(out * U(0x9FB21C651E98DF25) + h[j : j + n])
    return out


def item_blocks(items: DataFrame, rate: float, exact_below: int) -> Iterator[tuple[ItemIndex, bool]]:
    """The index of each block of items(item_id, text), and whether there are others."""
    some = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = some.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        # spread by hash over blocks of BLOCK_BYTES in the mean
        rows = some.where(block == b).orderBy("item_id", "text").collect()
        if rows:
            yield ItemIndex([(r.item_id, r.text) for r in rows], rate, exact_below), blocks > 1


MATCH = "doc_id long, item_id long, start_word int, end_word int, distance int"


def find_matches(docs: DataFrame, items: DataFrame, rate: float = RATE, exact_below: int = 0) -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, start_word, end_word, distance."""
    spark, found = docs.sparkSession, None
    for index, many in item_blocks(items, rate, exact_below):
        shared = spark.sparkContext.broadcast(index)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                own = shared.value.matches(batch.column(1))
                if own:
                    row, item, start, end, distance = (np.array(x) for x in zip(*own, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), *(pa.array(x, pa.int32()) for x in (start, end, distance))],
                        ["doc_id", "item_id", "start_word", "end_word", "distance"],
                    )

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(match, MATCH)
        if many:
            rows = kept(rows, "matches")
            shared.unpersist()
        found = rows if found is None else found.unionByName(rows)
    return spark.createDataFrame([], MATCH) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, exact_below: int = 0) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    for index, many in item_blocks(items, rate, exact_below):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                stay = np.ones(batch.num_rows, bool)
                stay[[m[0] for m in shared.value.matches(batch.column(batch.schema.get_field_index("text")))]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(clean, docs.schema)
        if many:
            docs = kept(docs, "clean")
            shared.unpersist()
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_matches(docs, items)
