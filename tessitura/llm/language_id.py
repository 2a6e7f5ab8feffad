"""Language identification by a byte convolutional network (operator 5).

A text is cut into windows of WINDOW bytes, the last one padded.  Filters of several
widths slide over a window's bytes, each filter's largest response is taken, and a
softmax layer turns these into probabilities of the languages.  A text's probabilities
are the mean over all its windows, weighed by their bytes; the prediction is the
largest, its score that mean.

The network is small and trained here, in numpy, with Adam, on windows of labelled texts: at
most SAMPLE_DOCS documents for each language, those with the smallest hash of their id, and
WINDOWS_PER_DOC windows of each.  These are the bounds of what reaches the driver: about
150 KB for each language, of which any number is learned.  Windows of under SHORT bytes are
left out if their language has longer ones.  Beyond STEP_LANGS languages the steps of
training grow with their number.  Training is seeded and sees its sample in one
order, so that a second run gives the same network.

Prediction covers every byte of every text.  The network goes to the executors as a broadcast
of fixed size.

Defined results: a null text, or one without letters, is ``und`` with score 0; without
a labelled text every document is ``und``; a null doc_id counts as the empty text when
documents are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm.blocks import SEPARATORS, chunks, text_bytes
from tessitura.llm.mixing import hash_unit

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 12
SAMPLE_DOCS, WINDOWS_PER_DOC, SHORT = 300, 2, 32
STEPS, STEP_LANGS, BATCH, RATE, SEED = 500, 64, 64, 0.02, 7
UNKNOWN = "und"
#: Bytes as the network sees them: A-Z in lower case, digits alike, separators and padding 0.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] += 32
_SEEN[48:58] = 48
_SEEN[SEPARATORS] = 0
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


class ByteNet:
    """tables[w]: (w, 256, FILTERS), the response of each filter to each byte at each place of a filter of width w."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _responses(self, x: np.ndarray, w: int) -> np.ndarray:
        n = x.shape[1] - w + 1
        r = self.tables[w][0][x[:, :n]]
        for j in range(1, w):
            r += self.tables[w][j][x[:, j : j + n]]
        return r

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each window, cut off at 0."""
        top = np.concatenate([self._responses(x, w).max(axis=1) for w in WIDTHS], axis=1)
        return np.maximum(top + self.bias, 0)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self.pooled(x)) if len(x) else np.zeros((0, len(self.langs)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, pick: np.ndarray, steps: int = STEPS) -> ByteNet:
        """Learns from the windows x[pick] of the languages y[pick]."""
        rng = np.random.default_rng(SEED + 1)
        params = [*self.tables.values(), self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, steps + 1):
            i = pick[rng.integers(0, len(pick), BATCH)]
            xb, rows = x[i], np.arange(BATCH)[:, None]
            places, tops = {}, []
            for w in WIDTHS:
                r = self._responses(xb, w)
                places[w] = r.argmax(axis=1)
                tops.append(np.take_along_axis(r, places[w][:, None], axis=1)[:, 0])
            raw = np.concatenate(tops, axis=1) + self.bias
            pooled = np.maximum(raw, 0)
            error = self._softmax(pooled)
            error[rows[:, 0], y[i]] -= 1
            error /= BATCH
            back = (error @ self.out.T) * (raw > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(self.tables[w])
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (xb[rows, places[w] + j], np.arange(FILTERS)[None, :]), own)
                grads.append(g)
            grads += [back.sum(axis=0), pooled.T @ error, error.sum(axis=0)]
            rate = RATE * (1 - (step - 1) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
        return self


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows of bytes, text of each, bytes of text in each)."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    used = np.minimum(WINDOW, lengths[doc] - nth * WINDOW)
    x = np.zeros((len(doc), WINDOW), np.uint8)
    inside = np.arange(WINDOW) < used[:, None]
    x[inside] = _SEEN[raw]
    return x, doc, used


def has_letter(texts: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return found


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def train_language_net(labelled: DataFrame) -> ByteNet | None:
    """A network from labelled(doc_id, text, lang); None if there is no labelled text."""
    labelled = labelled.where("text is not null and lang is not null and length(text) > 0")
    counts = labelled.groupBy("lang").count()
    # twice the share that gives SAMPLE_DOCS: the hash may be uneven
    shares = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), 2 * SAMPLE_DOCS / F.col("count")).alias("_share"))
    u = hash_unit("language", F.col("doc_id"))
    length = F.length("text")
    pieces = F.concat(*(F.substring(F.col("text"), (F.floor(F.greatest(length - WINDOW, F.lit(0)) * (k / max(1, WINDOWS_PER_DOC - 1))) + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_PER_DOC)))
    sample = labelled.withColumn("_u", u).join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(F.col("_u") < F.col("_share")).select("lang", "_u", pieces.alias("piece"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "piece"))
    rows = sample.withColumn("_nth", nth).where(F.col("_nth") <= SAMPLE_DOCS).select("lang", "_u", "piece").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["_u"], r.lang, r.piece))
    langs = sorted({r.lang for r in rows})
    place = {v: k for k, v in enumerate(langs)}
    texts, y = [r.piece for r in rows], [place[r.lang] for r in rows]
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    x, doc, used = windows(raw, offsets)
    own = np.array(y)[doc]
    # as many windows of each language, by repetition
    order = np.argsort(own, kind="stable")
    by = np.split(order, np.searchsorted(own[order], np.arange(1, len(langs))))
    by = [b[used[b] >= SHORT] if (used[b] >= SHORT).any() else b for b in by]
    most = max(len(b) for b in by)
    pick = np.concatenate([np.resize(b, most) for b in by])
    return ByteNet(langs).fit(x, own, pick, STEPS * max(1, -(-len(langs) // STEP_LANGS)))


def judge(texts: pa.Array, net: ByteNet | None) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text."""
    raw, offsets = text_bytes(texts)
    n = len(texts)
    lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
    if net is not None and len(raw):
        x, doc, used = windows(raw, offsets)
        p = np.concatenate([net(x[a : a + 512]) for a in range(0, len(x), 512)])
        total = np.zeros((n, len(net.langs)))
        np.add.at(total, doc, p * used[:, None])
        known = has_letter(texts, raw, offsets)
        mean = total / np.maximum(1, np.diff(offsets))[:, None]
        best = mean.argmax(axis=1)
        lang[known] = np.array(net.langs, object)[best[known]]
        score[known] = np.clip(mean[np.arange(n), best], 0, 1)[known]
    return lang, score


def identify_language(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """docs with lang_pred and score in place of any columns of these names; all other columns are kept."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    out = T.StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lang, score = judge(batch.column(batch.schema.get_field_index("text")), model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang.tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(predict, out)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the documents that aren't held out."""
    net = train_language_net(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))))
    return identify_language(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_identified(docs: DataFrame, net: ByteNet | None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of at least ``least``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lang, score = judge(batch.column(batch.schema.get_field_index("text")), model.value)
            yield batch.filter(pa.array((lang != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(keep, docs.schema)
