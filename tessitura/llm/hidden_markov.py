"""Language-model scores by a hidden Markov model (operator 8).

Tokens are the words of a text in lower case (A-Z), then one end.  Training texts are
those that aren't held out.

*Counts.*  Every word of the training texts is counted by a packed exchange, and the
counts stay in a table by hash bucket.  The TOP most frequent words, a bounded table, go to all
tasks; rarer words of a text are asked for in the buckets and come back as one sum for each text.
So each text gets its exact unigram score whatever the size of the vocabulary.

*Model.*  The model's symbols are the SYMBOLS most frequent words, the end, and 256 classes of
all other words, by their last two bytes.  A word of a class has within it the chance
(c + 0.5) / (C + 0.5 (V + 1)), with its count c and the class's words C and different words V, as
the unigram model has.  STATES latent states emit symbols.  Baum-Welch: tasks run the scaled
forward and backward recursions over all texts that they read and send expected
counts; sums of a fixed number of cells come back and give the next model.  Rounds go on until the
likelihood of a token gains less than GAIN (log10), ROUNDS at most.  A bounded sample
(SAMPLE texts, of longer ones a window of SAMPLE_CHARS) only gives the model from which this
starts; if nothing is drawn, that is a random one.

*Score.*  The scaled forward recursion, in double, gives the likelihood of the symbols summed
over all paths of states, and the words within their classes follow from counts.  Training runs in
single precision.  Texts run side by side, ordered by length, so
that one step of the recursion is one small matrix product.

Defined results: a null text is the end alone; a null doc_id counts as the empty text
when texts are held out; rows that repeat another are scored alike and each of them is
counted; without training texts every token has the chance 1 in the base score; a text of any
length is scored as a whole, and TOKENS bounds how many run beside it; of words with equal
counts those of smaller hashes are symbols.  Of docs only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.blocks import PACKED, Words, buckets_for, chunks, exchange, gather, kept, mix, pack, runs, scatter, tokenise, unpack
from tessitura.llm.language_id import held_out
from tessitura.llm.mixing import hash_unit
from tessitura.llm.word_counts import Counter

U = np.uint64
TOP, SYMBOLS, CLASSES = 1 << 18, 4096, 256
STATES, ROUNDS, SAMPLE, SAMPLE_ROUNDS = 6, 3, 600, 12
GAIN = 0.005
SAMPLE_CHARS = 10_000
TOKENS = 1_000_000  # tokens that run side by side
FOLD = 1
END = SYMBOLS + CLASSES
CELLS = STATES + STATES**2 + (END + 1) * STATES + 1  # expected counts, and the likelihood
SMOOTH = 0.1
_CUT_BEGIN, _NO_WORD = re.compile(r"\A[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_classes(w: Words) -> np.ndarray:
    """The class of each word, from its last two bytes in lower case."""
    last = _LOWER[w.raw[w.ends - 1]].astype(U)
    second = np.where(w.ends - w.starts > 1, _LOWER[w.raw[np.maximum(w.ends - 2, 0)]], 0).astype(U)
    return (mix(last * U(257) + second) >> U(56)).astype(np.uint8)


@dataclass
class Vocabulary:
    """What all tasks know: the most frequent words and the sums."""

    h: np.ndarray  # hashes of the TOP words, tagged with their classes, ascending
    c: np.ndarray  # their counts
    symbol: np.ndarray  # their symbols: below SYMBOLS, or SYMBOLS + class
    total: int  # N
    distinct: int  # V
    ends: int  # training texts
    class_words: np.ndarray  # C of each class
    class_distinct: np.ndarray  # V of each class

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, count or -1, symbol, class) of each word."""
        h, cls = w.hashes(fold=True), word_classes(w)
        if not len(self.h):
            return h, np.full(len(h), -1), SYMBOLS + cls.astype(np.int64), cls
        tag = tagged(h, cls)
        at = np.minimum(np.searchsorted(self.h, tag), len(self.h) - 1)
        hit = self.h[at] == tag
        return h, np.where(hit, self.c[at], -1), np.where(hit, self.symbol[at], SYMBOLS + cls.astype(np.int64)), cls

    @property
    def log_base(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    @property
    def log_class(self) -> np.ndarray:
        return np.log10(self.class_words + 0.5 * (self.class_distinct + 1))


def count_words(train: DataFrame, n: int) -> DataFrame:
    """Packed (h, c, cls) of all words of train(text), each word once, in the row of its bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the class is a part of the key: it depends on the word alone
        counters = Counter()

        def send(key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return scatter(key, {"h": key, "c": c}, n)

        for batch in chunks(batches):
            w = tokenise(batch.column(0))
            h, c = np.unique(tagged(w.hashes(fold=True), word_classes(w)), return_counts=True)
            for found in counters.add(h, c):
                yield send(*found)
        h, c = counters.rest()
        if len(h):
            yield send(h, c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = gather(batches, {"h": "<u8", "c": "<i8"})
        order = np.argsort(x["h"], kind="stable")
        begins, _ = runs(x["h"][order])
        if len(begins):
            h, c = x["h"][order][begins], np.add.reduceat(x["c"][order], begins)
            yield scatter(h, {"h": h, "c": c}, n)

    return exchange(train.select("text").mapInArrow(count, PACKED), n, add, PACKED)


def tagged(h: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The hash of a word with its class as the lowest byte."""
    return (h & ~U(255)) | cls.astype(U)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """Sums over all words, and the most frequent ones: those over the least count that leaves TOP of them or fewer."""
    bins = 64 * 64

    def level(c: np.ndarray) -> np.ndarray:  # counts in ascending levels, 64 for each power of two
        return np.minimum((np.log2(c.astype(float)) * 64).astype(np.int64), bins - 1)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, words, distinct = np.zeros(bins, np.int64), np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            x = gather([batch], {"h": "<u8", "c": "<i8"})
            levels += np.bincount(level(x["c"]), minlength=bins)
            cls = (x["h"] & U(255)).astype(np.int64)
            np.add.at(words, cls, x["c"])
            distinct += np.bincount(cls, minlength=CLASSES)
        cells = np.concatenate([levels, words, distinct])
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(cells[used])], ["cell", "x"])

    cells = np.zeros(bins + 2 * CLASSES, np.int64)
    for r in counts.mapInArrow(summarise, "cell int, x long").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        cells[r.cell] = r.x
    levels, words, distinct = np.split(cells, [bins, bins + CLASSES])
    over = np.cumsum(levels[::-1])[::-1]
    least = int(np.argmax(over <= TOP)) if (over <= TOP).any() else bins

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = gather([batch], {"h": "<u8", "c": "<i8"})
            use = level(x["c"]) >= least
            if use.any():
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack({c: v[use] for c, v in x.items()})], pa.binary())], ["bucket", "payload"])

    parts = [unpack(bytes(r.payload)) for r in counts.mapInArrow(frequent, PACKED).collect()]
    h, c = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in (("h", U), ("c", np.int64)))
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    cls = (h & U(255)).astype(np.int64)
    symbol = np.where(np.arange(len(h)) < SYMBOLS, np.arange(len(h)), SYMBOLS + cls)
    own = slice(0, min(SYMBOLS, len(h)))
    np.subtract.at(words, cls[own], c[own])
    np.subtract.at(distinct, cls[own], 1)
    total = int(words.sum() + c[own].sum()) + ends
    n_distinct = int(distinct.sum() + own.stop) + (ends > 0)
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], symbol[order], total, n_distinct, ends, words, distinct)


class HiddenMarkov:
    """start (K), move (K, K) and emit (symbols, K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = (x.astype(np.float32) for x in (start, move, emit))

    @classmethod
    def random(cls, seed: int = 5) -> HiddenMarkov:
        rng = np.random.default_rng(seed)
        emit = rng.gamma(2.0, 1.0, (END + 1, STATES))
        return cls(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), emit / emit.sum(axis=0))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> HiddenMarkov:
        start, move, emit = split_counts(counts + SMOOTH)
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))

    def _forward(self, obs: np.ndarray, at: np.ndarray, kind=np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, scaled forward values, scales) in order of steps; at: where each step begins."""
        start, move = self.start.astype(kind), self.move.astype(kind)
        seen = self.emit.astype(kind)[obs]
        alpha, scale = np.empty_like(seen), np.empty(len(obs), kind)
        before = None
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            x = seen[a:b] * (start if before is None else before[: b - a] @ move)
            s = x.sum(axis=1)
            scale[a:b] = s
            before = alpha[a:b] = x / s[:, None]
        return seen, alpha, scale

    def log10(self, obs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the chance of each text, given all symbols one text after the other."""
        place, at, doc = by_step(lengths)
        _, _, scale = self._forward(obs[place], at, np.float64)
        return np.bincount(doc[place], weights=np.log10(scale), minlength=len(lengths))

    def expect(self, obs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of starts, moves and emissions, in one array, and at last the log10 of the chance of all texts."""
        place, at, _ = by_step(lengths)
        obs = obs[place]
        seen, alpha, scale = self._forward(obs, at)
        move = np.zeros((STATES, STATES))
        gamma = alpha  # turned into the chances of states from the last step on
        ahead = None
        for a, b in zip(at[-2::-1].tolist(), at[:0:-1].tolist(), strict=True):
            if ahead is not None:
                k = len(ahead)
                move += self.move * (alpha[a : a + k].T @ ahead)
                gamma[a : a + k] *= ahead @ self.move.T
            # of the texts that go on and of those that end here
            x = seen[a:b].copy()
            if ahead is not None:
                x[:k] *= ahead @ self.move.T
            ahead = x / scale[a:b, None]
        emit = np.stack([np.bincount(obs, weights=gamma[:, k], minlength=END + 1) for k in range(STATES)], axis=1)
        start = gamma[: at[1]].sum(axis=0) if len(at) > 1 else np.zeros(STATES)
        return np.concatenate([start, move.ravel(), emit.ravel(), [np.log10(scale.astype(float)).sum()]])


def split_counts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x[:STATES], x[STATES : STATES + STATES**2].reshape(STATES, STATES), x[STATES + STATES**2 : CELLS - 1].reshape(END + 1, STATES)


def by_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, at, doc): symbols ordered by step and, in a step, the longest text first; where steps begin; the text of each symbol."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.empty(len(lengths), np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    step = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.concatenate([[0], np.cumsum(np.bincount(step))]) if len(doc) else np.zeros(1, np.int64)
    place = np.empty(len(doc), np.int64)
    place[at[step] + rank[doc]] = np.arange(len(doc))
    return place, at, doc


def with_ends(symbols: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with the end after each text, and the lengths."""
    return np.insert(symbols, w.first[1:], END), w.counts + 1


def symbol_batches(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and lengths of as many texts as run side by side."""
    held, size = [], 0
    for batch in chunks(batches):
        w = tokenise(batch.column(batch.schema.get_field_index("text")))
        held.append(with_ends(words.look_up(w)[2].astype(np.int32), w))
        size += len(held[-1][0])
        if size > TOKENS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def whole_words(piece: str | None, begin: int | None, cut: bool | None) -> str:
    """A window of a text without the words that it may have cut in two: at its end if cut, at its begin if that isn't the text's."""
    piece = _CUT_BEGIN.sub("", piece or "", count=1) if begin else piece or ""
    return piece[: len(piece) - len(_NO_WORD.split(piece)[-1])] if cut else piece


def train_model(train: DataFrame, words, rounds: int = ROUNDS) -> HiddenMarkov:
    """Baum-Welch over all texts of train(doc_id, text); words: a broadcast Vocabulary."""
    sc = train.sparkSession.sparkContext
    n = max(1, words.value.ends)
    # by text and id: ids may be null or repeat
    own = F.xxhash64("doc_id", "text")
    drawn = train.where(hash_unit("markov", own) < min(1.0, 2 * SAMPLE / n)).select("text", own.alias("own"))
    begin = F.floor(hash_unit("window", F.col("own")) * F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int")
    pieces = drawn.select("own", begin.alias("begin"), F.substring("text", begin + 1, F.lit(SAMPLE_CHARS)).alias("piece"), (begin + SAMPLE_CHARS < F.length("text")).alias("cut"))
    sample = pieces.orderBy("own", "piece").limit(SAMPLE).collect()
    model = HiddenMarkov.random()
    w = tokenise(pa.array([whole_words(r.piece, r.begin, r.cut) for r in sample], pa.string()))
    obs, lengths = with_ends(words.value.look_up(w)[2].astype(np.int32), w)
    for _ in range(SAMPLE_ROUNDS if len(obs) else 0):
        model = HiddenMarkov.from_counts(model.expect(obs, lengths))
    before = -np.inf
    for _ in range(rounds if words.value.ends else 0):
        now = sc.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = 0
            for obs, lengths in symbol_batches(batches, words.value):
                total = total + now.value.expect(obs, lengths)
            if isinstance(total, np.ndarray):
                used = np.flatnonzero(total)
                for a in range(0, len(used), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(used[a : a + 5000], pa.int32()), pa.array(total[used[a : a + 5000]])], ["cell", "x"])

        counts = np.zeros(CELLS)
        # cells of a fixed number, whatever the corpus
        for r in train.select("text").mapInArrow(expect, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
            counts[r.cell] = r.x
        model = HiddenMarkov.from_counts(counts)
        likelihood = counts[-1] / words.value.total
        if likelihood - before < GAIN:
            break
        before = likelihood
    return model


def text_key(batch: pa.RecordBatch, w: Words, h: np.ndarray) -> np.ndarray:
    """A hash of each text's words, to tell texts of one doc_id apart."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + np.arange(len(h), dtype=U) - np.repeat(w.first[:-1], w.counts).astype(U)))])
    return mix(sums[w.first[1:]] - sums[w.first[:-1]] + w.counts.astype(U)).view(np.int64)


def rare_words(docs: DataFrame, counts: DataFrame, words, n: int) -> DataFrame:
    """key, text_key, rare_log (sum of log10(c + 0.5)) and rare_known of the words that aren't in the bounded table."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = tokenise(batch.column(1))
            h, c, _, cls = words.value.look_up(w)
            own = np.flatnonzero(c < 0)
            if not len(own):
                continue
            doc, tag = w.doc[own], tagged(h[own], cls[own])
            order = np.lexsort((tag, doc))
            doc, tag = doc[order], tag[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(doc)))
            key, text = batch.column(0).to_numpy(zero_copy_only=False), text_key(batch, w, h)
            yield scatter(tag[at], {"h": tag[at], "c": np.full(len(at), -1, np.int64), "key": key[doc[at]], "text": text[doc[at]], "times": times.astype(np.int32)}, n)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = [], []
        for batch in batches:
            for p in batch.column(1):
                x = unpack(p.as_buffer())
                (asked if "key" in x else known).append(x)
        if not asked:
            return
        x = {c: np.concatenate([p[c] for p in asked]) for c in asked[0]}
        h, c = (np.concatenate([np.zeros(0, t), *(p[k] for p in known)]) for k, t in (("h", U), ("c", np.int64)))
        order = np.argsort(h)
        h, c = h[order], c[order]
        # rows that repeat another ask the same
        order = np.lexsort((x["h"], x["text"], x["key"]))
        x = {k: v[order] for k, v in x.items()}
        new = np.ones(len(order), bool)
        new[1:] = (x["h"][1:] != x["h"][:-1]) | (x["text"][1:] != x["text"][:-1]) | (x["key"][1:] != x["key"][:-1])
        x = {k: v[new] for k, v in x.items()}
        at = np.minimum(np.searchsorted(h, x["h"]), max(0, len(h) - 1))
        found = np.where(h[at] == x["h"], c[at], 0) if len(h) else np.zeros(len(x["h"]), np.int64)
        first = np.ones(len(found), bool)
        first[1:] = (x["text"][1:] != x["text"][:-1]) | (x["key"][1:] != x["key"][:-1])
        begins = np.flatnonzero(first)
        logs = np.add.reduceat(x["times"] * np.log10(found + 0.5), begins)
        known_ = np.add.reduceat(x["times"].astype(np.int64) * (found > 0), begins)
        # packed again: a text has words in many buckets
        key, text = x["key"][begins], x["text"][begins]
        yield scatter(key.view(U) ^ text.view(U), {"key": key, "text": text, "logs": logs, "known": known_}, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = gather(batches, {"key": "<i8", "text": "<i8", "logs": "<f8", "known": "<i8"})
        order = np.lexsort((x["logs"], x["text"], x["key"]))  # one order of sums, whatever came first
        x = {k: v[order] for k, v in x.items()}
        if not len(order):
            return
        first = np.ones(len(order), bool)
        first[1:] = (x["text"][1:] != x["text"][:-1]) | (x["key"][1:] != x["key"][:-1])
        begins = np.flatnonzero(first)
        yield pa.RecordBatch.from_arrays([pa.array(x["key"][begins]), pa.array(x["text"][begins]), pa.array(np.add.reduceat(x["logs"], begins)), pa.array(np.add.reduceat(x["known"], begins))], ["key", "text_key", "rare_log", "rare_known"])

    asked = docs.select("key", "text").mapInArrow(ask, PACKED)
    told = exchange(asked.unionByName(counts), n, tell, PACKED)
    return exchange(told, n, add, "key long, text_key long, rare_log double, rare_known long")


def known_scores(docs: DataFrame, words, model) -> DataFrame:
    """Each row's likelihood by the model, and its sums over the words of the bounded table."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, size = words.value, [], 0
        log_class, log_end = v.log_class, np.log10(v.ends + 0.5)

        def run() -> pa.RecordBatch:
            obs, lengths = (np.concatenate([p[i] for p in held]) for i in (0, 1))
            likelihood = model.value.log10(obs, lengths)
            own = [np.concatenate([p[i] for p in held]) for i in range(2, 8)]
            ids = pa.concat_arrays([p[8] for p in held])
            return pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in own), pa.array(lengths), pa.array(likelihood)], names)

        def sums(x: np.ndarray, w: Words) -> np.ndarray:
            return np.bincount(w.doc, weights=x, minlength=len(w.first) - 1)

        for batch in chunks(batches):
            w = tokenise(batch.column(2))
            h, c, symbol, cls = v.look_up(w)
            logs = np.log10(np.maximum(c, 0) + 0.5)
            in_table, in_class = c >= 0, symbol >= SYMBOLS
            held.append(
                (
                    *with_ends(symbol.astype(np.int32), w), batch.column(1).to_numpy(zero_copy_only=False), text_key(batch, w, h),
                    sums(in_table * logs, w) + log_end, (sums(in_table & (c > 0), w) + (v.ends > 0)).astype(np.int64),
                    sums(in_class * (in_table * logs - log_class[cls]), w), sums(~in_table, w).astype(np.int64), batch.column(0),
                )
            )
            size += len(held[-1][0])
            if size > TOKENS:
                yield run()
                held, size = [], 0
        if held:
            yield run()

    names = ["doc_id", "key", "text_key", "table_log", "table_known", "class_log", "n_rare", "n_tokens", "likelihood"]
    return docs.select("doc_id", "key", "text").mapInArrow(score, "doc_id long, key long, text_key long, table_log double, table_known long, class_log double, n_rare long, n_tokens long, likelihood double")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text)."""
    n = buckets_for(docs)
    sc = docs.sparkSession.sparkContext
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), "text")
    train = keyed.where(~held_out(F.col("doc_id"), fold=FOLD))
    counts = kept(count_words(train, n), "word-counts")
    words = sc.broadcast(vocabulary(counts, train.count()))
    model = sc.broadcast(train_model(train, words))
    scores = known_scores(keyed, words, model).join(rare_words(keyed, counts, words, n), ["key", "text_key"], "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    return scores.select(
        "doc_id", held_out(F.col("doc_id"), fold=FOLD).alias("held_out"), "n_tokens",
        (F.col("table_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.value.total).cast("long").alias("train_tokens"),
        (F.col("table_log") + rare - F.col("n_tokens") * F.lit(words.value.log_base)).alias("base_score"),
        (F.col("likelihood") + F.col("class_log") + rare).alias("score"),
    )


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
