"""Repeated passages by prefix-partitioned suffix trees (operator 2).

A passage of ``least`` words or more that occurs again is an internal node, at least that
deep, of the suffix tree of all texts.  The tree is sparse (some words start a suffix) and
never whole: its suffixes are dealt into subtrees by their first words.

1. *Suffixes.*  A window of ``least`` words is represented by its anchor, the place of the
   smallest hash of its ANCHOR-word runs, the leftmost one.  Equal windows have equal
   anchors and neighbouring windows share theirs, so that one suffix, with the words
   before it, stands for several windows.  Anchors whose first words occur once in the
   corpus rule out all their windows.
2. *Prefixes.*  A subtree takes all suffixes of one prefix of ANCHOR words, unless they are
   over SUBTREE, as an exact count says.  Then each window of these is a suffix of its own with a
   prefix of about half its words, and where that is too many as well, of all its words.
3. *Subtrees.*  A task has the words of its suffixes.  It goes down from the prefix word by word,
   splitting nodes where the next words differ and leaving what is alone: what is left at
   depth ``least - r`` are the deep internal nodes.  A window that starts r words before its
   suffix belongs to such a node and, going left in the same way, to a node of the r words
   before.  Windows of one pair of nodes have equal words; words are compared, not a hash
   of a passage.  The first one in the corpus stays and all others are repeats of it.
4. *Maximal repeats.*  Repeats at consecutive places that go on together are joined, and
   the words in them are removed.

A passage that stands in a third of all documents does not gather in one task: a task
settles the repeats among its own texts and sends only the first of suffixes with equal
surroundings.

A row is known by its doc_id and a hash of its text; a window is earlier if its doc_id is
smaller, or in the same row if it starts earlier.  Defined results: a null text has no words; a
null doc_id comes before all others; documents of fewer than ``least`` words stay as they are;
of rows with one doc_id none is earlier than the others, so that they don't repeat each other; rows that
are equal get equal results; texts of any length are cut into pieces of work by document
only, and a very long one is a piece of its own.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.blocks import PACKED, Words, buckets_for, chunks, exchange, gather, gather_ragged, kept, mix, ragged, runs, scatter, scatter_ragged, tokenise
from tessitura.llm.word_counts import packed_counts

U = np.uint64
LEAST = 20
ANCHOR = 6
SUBTREE = 200_000  # suffixes of one prefix from which on it is made longer
LONGER = 500_000  # prefixes that are made longer, at most: 4 MB
UNIT = 1_000_000  # anchors, or words, that a task settles among itself
NO_ID = -(1 << 63)
_PLACE_BITS = 24


class Texts:
    """Word hashes of a batch and what is derived from them."""

    def __init__(self, batch: pa.RecordBatch, least: int):
        self.words: Words = tokenise(batch.column(batch.schema.get_field_index("text")))
        self.h = self.words.hashes(fold=False)
        n, doc = len(self.h), self.words.doc
        #: places of windows: word indices that ``least`` words of their document follow
        self.at = np.flatnonzero(doc[: n - least + 1] == doc[least - 1 :]) if n >= least else np.zeros(0, np.int64)
        self.least = least

    def run_hashes(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; a run may cross documents and is then of no use."""
        out = mix(self.h + U(k))
        for j in range(1, k):
            ahead = np.zeros(len(self.h), U)
            ahead[:-j] = self.h[j:]
            out = mix(out * U(0x9FB21C651E98DF25) + ahead)
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the anchor of each window."""
        grams, span = self.run_hashes(ANCHOR), self.least - ANCHOR + 1
        place = np.empty(len(self.at), np.int64)
        step = 1 << (_PLACE_BITS - 1)
        for low in range(0, len(grams), step):
            own = slice(*np.searchsorted(self.at, [low, low + step]))
            if own.start == own.stop:
                continue
            part = grams[low : low + step + span]
            key = (part >> U(_PLACE_BITS) << U(_PLACE_BITS)) | np.arange(len(part), dtype=U)
            done, width = key, 1
            while width < span:
                shift = min(width, span - width)
                done = np.minimum(done[: len(done) - shift], done[shift:])
                width += shift
            place[own] = (done[self.at[own] - low] & U((1 << _PLACE_BITS) - 1)).astype(np.int64) + low
        return place, grams[place]


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def row_bucket(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    return doc.view(U) ^ mix(th.astype(np.int64).view(U))


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def kinded(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * rows.num_rows, pa.int32()), *rows.columns], ["kind", "bucket", "payload"])


def passing(batches: Iterator[pa.RecordBatch], posts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1 as they are; those of kind 0 go to posts."""
    for batch in batches:
        kind = batch.column(0).to_numpy()
        own = batch.filter(pa.array(kind == 1)).select(["bucket", "payload"])
        if own.num_rows:
            yield own
        posts.append(batch.filter(pa.array(kind == 0)))


# anchors

ANCHORS = "doc long, th int, anchors binary"
_COUNTED = {"h": "<u8", "doc": "<i8", "th": "<i4", "c": "<i8"}


def repeated_anchors(docs: DataFrame, least: int, n: int, subtree: int) -> DataFrame:
    """docs(doc, th, text) to doc, th and anchors (binary): the anchors of a row that occur again anywhere.

    Rows without doc list the anchors of more than ``subtree`` suffixes, the largest ones of each bucket.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            h, doc, th = (np.concatenate(p) for p in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, th = h[order], doc[order], th[order]
            begins, counts = runs(h)
            many = np.flatnonzero(np.repeat(counts, counts) > 1)
            yield kinded(0, scatter(h[begins], {"h": h[begins], "doc": doc[begins], "th": th[begins], "c": counts}, n))
            if len(many):
                yield kinded(1, scatter(row_bucket(doc[many], th[many]), {"h": h[many], "doc": doc[many], "th": th[many]}, n))

        held, size = [], 0
        for batch in chunks(batches):
            t = Texts(batch, least)
            place, h = t.anchors()
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            row = t.words.doc[place[new]]
            held.append((h[new], column(batch, "doc")[row], column(batch, "th")[row]))
            size += int(new.sum())
            if size > UNIT:
                yield from settle()
                held, size = [], 0
        if size:
            yield from settle()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts: list[pa.RecordBatch] = []
        for rows in passing(batches, posts):
            yield kinded(1, rows)
        x = gather(posts, _COUNTED)
        order = np.argsort(x["h"], kind="stable")
        x = {c: v[order] for c, v in x.items()}
        begins, counts = runs(x["h"])
        if not len(begins):
            return
        tell = (np.repeat(counts, counts) > 1) & (x["c"] == 1)  # the others know already
        if tell.any():
            yield kinded(1, scatter(row_bucket(x["doc"][tell], x["th"][tell]), {c: x[c][tell] for c in ("h", "doc", "th")}, n))
        total = np.add.reduceat(x["c"], begins)
        full = np.flatnonzero(total > subtree)
        if len(full):
            full = full[np.argsort(-total[full], kind="stable")][: max(1, LONGER // n)]
            yield kinded(2, scatter(x["h"][begins][full], {"h": x["h"][begins][full]}, n))

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = []
        for batch in batches:
            kind = batch.column(0).to_numpy()
            full = gather([batch.filter(pa.array(kind == 2))], {"h": "<u8"})["h"]
            if len(full):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([full.tobytes()], pa.binary())], ["doc", "th", "anchors"])
            posts.append(batch.filter(pa.array(kind == 1)))
        x = gather(posts, {"h": "<u8", "doc": "<i8", "th": "<i4"})
        order = np.lexsort((x["th"], x["doc"]))
        h, doc, th = x["h"][order], x["doc"][order], x["th"][order]
        begins, counts = row_runs(doc, th)
        for at in range(0, len(begins), 1000):
            part = slice(at, at + 1000)
            own = [np.unique(h[a : a + c]).tobytes() for a, c in zip(begins[part].tolist(), counts[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[begins[part]]), pa.array(th[begins[part]]), pa.array(own, pa.binary())], ["doc", "th", "anchors"])

    posts = exchange(docs.mapInArrow(post, f"kind int, {PACKED}"), n, meet, f"kind int, {PACKED}")
    return exchange(posts, n, by_row, ANCHORS)


def row_runs(doc: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the records of each row begin, and how many they are; records are in order of rows."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(doc)))


def long_prefixes(docs: DataFrame, anchors: DataFrame, least: int, n: int, subtree: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order: anchors whose windows are suffixes of their own; half windows whose windows have all their words as prefix."""

    def listed(rows: list) -> np.ndarray:
        return np.sort(np.concatenate([np.zeros(0, U), *(np.frombuffer(r.anchors, U) for r in rows)]))

    full = listed(anchors.where("doc is null").select("anchors").collect())  # LONGER, or one of each bucket, at most
    if not len(full):
        return full, full
    shared = docs.sparkSession.sparkContext.broadcast(full)

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        t = Texts(batch, least)
        return t.run_hashes(half(least))[t.at[member(shared.value, t.anchors()[1])]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = gather(batches, {"h": "<u8", "c": "<i8"})
        order = np.argsort(x["h"], kind="stable")
        begins, _ = runs(x["h"][order])
        if not len(begins):
            return
        total = np.add.reduceat(x["c"][order], begins)
        most = np.argsort(-total, kind="stable")[: max(1, LONGER // n)]
        most = most[total[most] > subtree]
        if len(most):
            yield pa.RecordBatch.from_arrays([pa.array([x["h"][order][begins][most].tobytes()], pa.binary())], ["anchors"])

    return full, listed(exchange(packed_counts(docs.select("text"), halves, n), n, add, "anchors binary").collect())


def half(least: int) -> int:
    return (ANCHOR + least) // 2


# suffixes

#: A suffix: its prefix, its row, its place among the row's words, how many words before and from it are known.
SUFFIX = {"prefix": "<u8", "doc": "<i8", "th": "<i4", "place": "<i4", "left": "u1", "right": "u1"}
#: ``n`` windows from ``start`` on that repeat those from ``from_start`` on.
MARKS = {"doc": "<i8", "th": "<i4", "start": "<i4", "n": "<i4", "from_doc": "<i8", "from_start": "<i4"}


class Suffixes:
    """Suffixes with the words around them: those of x[i] are flat[begin[i] : begin[i] + left + right]."""

    def __init__(self, x: dict[str, np.ndarray], begin: np.ndarray, flat: np.ndarray, least: int):
        self.x, self.begin, self.flat, self.least = x, begin, flat, least
        self.left, self.right = x["left"].astype(np.int64), x["right"].astype(np.int64)

    def __len__(self) -> int:
        return len(self.begin)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes({c: v[at] for c, v in self.x.items()}, self.begin[at], self.flat, self.least)

    @classmethod
    def of(cls, x: dict[str, np.ndarray], flat: np.ndarray, least: int) -> Suffixes:
        """With words one after the other."""
        lengths = x["left"].astype(np.int64) + x["right"]
        return cls(x, np.cumsum(lengths) - lengths, flat, least)

    @classmethod
    def join(cls, parts: list[Suffixes]) -> Suffixes:
        x = {c: np.concatenate([p.x[c] for p in parts]) for c in SUFFIX}
        before = np.cumsum([0, *(len(p.flat) for p in parts)])
        return cls(x, np.concatenate([p.begin + b for p, b in zip(parts, before[:-1].tolist(), strict=True)]), np.concatenate([p.flat for p in parts]), parts[0].least)

    def scattered(self, n: int) -> pa.RecordBatch:
        return scatter_ragged(self.x["prefix"], self.x, self.begin, self.left + self.right, self.flat, n)

    def marks(self, at: np.ndarray, back: np.ndarray, windows: np.ndarray, origin: np.ndarray) -> dict[str, np.ndarray]:
        """``windows`` windows from ``back`` words before the suffixes at on repeat those of the suffixes origin."""
        place = self.x["place"]
        out = {"doc": self.x["doc"][at], "th": self.x["th"][at], "start": place[at] - back, "n": windows, "from_doc": self.x["doc"][origin], "from_start": place[origin] - back}
        return {c: v.astype(MARKS[c]) for c, v in out.items()}

    def settled(self) -> tuple[dict[str, np.ndarray], Suffixes]:
        """Marks of suffixes that repeat another one with all the words around it, and the other suffixes in order of place."""
        x, lengths = self.x, self.left + self.right
        step = ragged(np.zeros(len(self), np.int64), lengths)
        sums = np.zeros(len(step) + 1, U)
        np.cumsum(mix(self.flat[ragged(self.begin, lengths)] ^ mix(step.astype(U) + U(17))), out=sums[1:])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        h = mix(sums[bounds[1:]] - sums[bounds[:-1]] + x["prefix"]) ^ (self.left * 256 + self.right).astype(U)
        order = np.lexsort((x["place"], x["th"], x["doc"], h))
        begins, counts = runs(h[order])
        first = order[np.repeat(begins, counts)]
        own, _ = row_runs_in(h[order], x["doc"][order], x["th"][order])
        earliest = order[own]  # in the same row
        sure = self._equal(order, first)
        equal = np.empty(len(self), bool)
        equal[order] = sure
        later = x["doc"][order] != x["doc"][first]
        # rows that are equal have their suffixes at equal places
        marked = sure & (later | ((x["place"][earliest] != x["place"][order]) & equal[earliest]))
        at, origin = order[marked], np.where(later, first, earliest)[marked]
        rest = np.sort(order[~marked])
        rest = rest[np.lexsort((x["place"][rest], x["th"][rest], x["doc"][rest]))]
        return self.marks(at, self.left[at], self.left[at] + self.right[at] - self.least + 1, origin), self.take(rest)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes a and b have one prefix and the same words around them."""
        same = (self.left[a] == self.left[b]) & (self.right[a] == self.right[b]) & (self.x["prefix"][a] == self.x["prefix"][b])
        lengths = np.where(same & (a != b), self.left[a] + self.right[a], 0)
        differ = self.flat[ragged(self.begin[a], lengths)] != self.flat[ragged(self.begin[b], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        found = np.concatenate([[0], np.cumsum(differ)])
        return same & (found[bounds[1:]] == found[bounds[:-1]])

    def descend(self, depth: int, step: int) -> Iterator[np.ndarray]:
        """The node of each suffix at the depths 0, 1, ... depth, going right (step 1) or left (-1); -1 where it is alone or has no words."""
        base, known = self.begin + self.left, self.right if step > 0 else self.left
        order = np.argsort(self.x["prefix"], kind="stable")
        key = self.x["prefix"][order]
        begins, counts = runs(key)
        node = np.repeat(begins, counts)
        for d in range(depth + 1):
            if d:
                use = known[order] >= d
                order, node = order[use], node[use]
                word = self.flat[base[order] + (d - 1 if step > 0 else -d)]
                split = np.zeros(len(order), bool)  # nodes whose next words differ are sorted, no others
                split[1:] = (node[1:] == node[:-1]) & (word[1:] != word[:-1])
                begins, counts = runs(node)
                rough = np.repeat(np.add.reduceat(split, begins) > 0, counts) if len(begins) else split
                if rough.any():
                    sub = np.lexsort((word[rough], node[rough]))
                    order[rough], word[rough] = order[rough][sub], word[rough][sub]
                new = np.ones(len(order), bool)
                new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
                begins = np.flatnonzero(new)
                counts = np.diff(np.append(begins, len(order)))
                node = np.repeat(begins, counts)
            many = np.repeat(counts, counts) > 1
            order, node = order[many], node[many]
            found = np.full(len(self), -1, np.int32)
            found[order] = node
            yield found

    def repeats(self) -> dict[str, np.ndarray]:
        """Marks of the windows that have the same words as an earlier one; suffixes are in order of place."""
        most = self.least - ANCHOR
        right = list(self.descend(self.least, 1))
        left = list(self.descend(min(most, int(self.left.max(initial=0))), -1))
        doc, th = self.x["doc"], self.x["th"]
        found = []
        for r in range(len(left) - 1, -1, -1):
            at = np.flatnonzero((left[r] >= 0) & (right[self.least - r] >= 0) & (self.left >= r) & (self.right >= self.least - r))
            if not len(at):
                continue
            key = right[self.least - r][at].astype(np.int64) << 32 | left[r][at]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            begins, counts = runs(key)
            first = at[np.repeat(begins, counts)]
            own, _ = row_runs_in(key, doc[at], th[at])
            later = doc[at] != doc[first]
            use = later | (self.x["place"][at[own]] != self.x["place"][at])
            found.append((at[use], np.full(int(use.sum()), r), np.where(later, first, at[own])[use]))
        if not found:
            return {c: np.zeros(0, t) for c, t in MARKS.items()}
        at, back, origin = (np.concatenate(p) for p in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")  # of one suffix the windows that start first come first
        at, back, origin = at[order], back[order], origin[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (origin[1:] != origin[:-1]) | (back[1:] != back[:-1] - 1)
        begins = np.flatnonzero(new)
        return self.marks(at[begins], back[begins], np.diff(np.append(begins, len(at))), origin[begins])


def row_runs_in(key: np.ndarray, doc: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each record, in order of key and row, the first one of that key and row; and where these are."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    begins = np.flatnonzero(new)
    return np.repeat(begins, np.diff(np.append(begins, len(key)))), begins


def suffixes_of(batch: pa.RecordBatch, least: int, full: np.ndarray, fuller: np.ndarray) -> Suffixes:
    """The suffixes that the windows of (doc, th, text, anchors) need; anchors: those of each row that occur again."""
    t = Texts(batch, least)
    place, h = t.anchors()
    known = batch.column(batch.schema.get_field_index("anchors"))
    row = t.words.doc[t.at]
    bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
    use = np.zeros(len(h), bool)
    for i in range(batch.num_rows):
        if known[i].is_valid and bounds[i + 1] > bounds[i]:
            use[bounds[i] : bounds[i + 1]] = member(np.frombuffer(known[i].as_buffer(), U), h[bounds[i] : bounds[i + 1]])
    alone = use & member(full, h)
    shared = np.flatnonzero(use & ~alone)
    begins, counts = runs(place[shared])
    low, high, p = t.at[shared[begins]], t.at[shared[begins + counts - 1]] + least, place[shared[begins]]
    prefix = h[shared[begins]]
    if alone.any():
        own = t.at[alone]
        longer = t.run_hashes(half(least))[own]
        whole = member(fuller, longer)
        if whole.any():
            longer[whole] = t.run_hashes(least)[own[whole]]
        low, high, p, prefix = np.concatenate([low, own]), np.concatenate([high, own + least]), np.concatenate([p, own]), np.concatenate([prefix, longer])
    own_row = t.words.doc[p]
    x = {"prefix": prefix, "doc": column(batch, "doc")[own_row], "th": column(batch, "th")[own_row], "place": p - t.words.first[own_row], "left": p - low, "right": high - p}
    return Suffixes({c: v.astype(SUFFIX[c]) for c, v in x.items()}, low, t.h, least)


def repeats(joined: DataFrame, least: int, prefixes, n: int) -> DataFrame:
    """(doc, th, text, anchors) to packed marks, dealt out by row."""

    def sent(marks: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(marks["doc"]):
            yield scatter(row_bucket(marks["doc"], marks["th"]), marks, n)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            marks, rest = Suffixes.join(held).settled()
            for rows in sent(marks):
                yield kinded(1, rows)
            yield kinded(0, rest.scattered(n))

        held, size = [], 0
        for batch in chunks(batches):
            own = suffixes_of(batch, least, *prefixes.value)
            if len(own):
                held.append(own)
                size += len(own.flat)
            if size > UNIT:
                yield from settle()
                held, size = [], 0
        if held:
            yield from settle()

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts: list[pa.RecordBatch] = []
        yield from passing(batches, posts)
        x, flat = gather_ragged(posts, SUFFIX)
        del posts
        if len(x["doc"]):
            marks, rest = Suffixes.of(x, flat, least).settled()
            yield from sent(marks)
            yield from sent(rest.repeats())

    return exchange(joined.mapInArrow(post, f"kind int, {PACKED}"), n, subtrees, PACKED)


REPEAT = "array<struct<start:int,end:int,from_id:long,from_start:int>>"


def maximal_repeats(marks: DataFrame, least: int, n: int) -> DataFrame:
    """Packed marks to doc, th and repeats: maximal runs of consecutive windows that go on together, with the words they cover."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = gather(batches, MARKS)
        order = np.lexsort((x["from_start"], x["from_doc"], x["start"], x["th"], x["doc"]))
        x = {c: v[order] for c, v in x.items()}
        if not len(order):
            return
        same = np.zeros(len(order), bool)
        same[1:] = (x["doc"][1:] == x["doc"][:-1]) & (x["th"][1:] == x["th"][:-1]) & (x["from_doc"][1:] == x["from_doc"][:-1])
        same[1:] &= (x["start"][1:] == x["start"][:-1] + x["n"][:-1]) & (x["from_start"][1:] == x["from_start"][:-1] + x["n"][:-1])
        at = np.flatnonzero(~same)
        last = np.append(at[1:], len(order)) - 1
        columns = {"start": x["start"][at], "end": x["start"][last] + x["n"][last] - 1 + least, "from_id": x["from_doc"][at], "from_start": x["from_start"][at]}
        kinds = {"start": pa.int32(), "end": pa.int32(), "from_id": pa.int64(), "from_start": pa.int32()}
        begins, counts = row_runs(x["doc"][at], x["th"][at])
        for i in range(0, len(begins), 1000):
            part = begins[i : i + 1000]
            own = slice(int(part[0]), int(part[-1] + counts[i : i + 1000][-1]))
            spans = pa.StructArray.from_arrays([pa.array(v[own], kinds[c]) for c, v in columns.items()], names=list(columns))
            offsets = np.append(part, own.stop) - own.start
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"][at][part]), pa.array(x["th"][at][part]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["doc", "th", "repeats"])

    return exchange(marks, n, join, f"doc long, th int, repeats {REPEAT}")


def find_repeats(docs: DataFrame, least: int = LEAST, subtree: int = SUBTREE) -> DataFrame:
    """docs(doc_id, text) to doc_id, text and repeats (null where there are none)."""
    n = buckets_for(docs)
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 32).cast("int").alias("th"), "text")
    anchors = kept(repeated_anchors(keyed.select("doc", "th", "text"), least, n, subtree), "anchors")
    prefixes = docs.sparkSession.sparkContext.broadcast(long_prefixes(docs, anchors, least, n, subtree))
    joined = keyed.join(anchors.where("doc is not null").hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "text", "anchors")
    found = maximal_repeats(repeats(joined, least, prefixes, n), least, n)
    return keyed.join(kept(found, "repeats").hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "text", "repeats")


def kept_texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, words removed, the other words joined by spaces) of each row of (text, repeats)."""
    w = tokenise(batch.column(batch.schema.get_field_index("text")))
    cover = np.zeros(len(w.starts) + 1, np.int32)
    spans = batch.column(batch.schema.get_field_index("repeats"))
    counts = np.array([len(s) if s.is_valid else 0 for s in spans])
    if counts.any():
        flat = spans.flatten()
        row = np.repeat(np.arange(len(counts)), counts)
        np.add.at(cover, flat.field("start").to_numpy() + w.first[row], 1)
        np.add.at(cover, flat.field("end").to_numpy() + w.first[row], -1)
    stay = np.cumsum(cover[:-1]) == 0
    sums = np.concatenate([[0], np.cumsum(stay)])
    n_kept = sums[w.first[1:]] - sums[w.first[:-1]]
    starts, ends, doc = w.starts[stay], w.ends[stay], w.doc[stay]
    n = len(w.raw)
    mask = np.zeros(n + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1
    mask = np.cumsum(mask[:-1]).astype(bool) if n else np.zeros(0, bool)
    # words that touch, at the end of one text and the start of the next, cancel out above and stay covered
    spaced = ends[:-1][doc[1:] == doc[:-1]] if len(doc) else ends
    out = w.raw.copy()
    out[spaced] = 32
    mask[spaced] = True
    bounds = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
    out = out[mask].tobytes()
    return w.counts, w.counts - n_kept, [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def remove_repeats(found: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the text that is left."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, removed, left = kept_texts(batch)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(left, pa.binary()).cast(pa.string())] if texts else [])], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if texts else [])]
    return found.select("doc_id", "text", "repeats").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if texts else ""))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")), texts=False)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
a AS (SELECT doc_id, list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' ')) AS v FROM d WHERE len(w) >= 20),
v AS (SELECT doc_id, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM a),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS nth FROM v),
x AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM o WHERE nth > 1),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
j AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""
