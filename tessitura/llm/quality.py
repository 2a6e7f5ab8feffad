"""Quality rules with risk-controlled thresholds (operator 4).

Every rule rejects documents whose measure is above a cutoff.  The cutoffs come from
labelled documents, a holdout on which nothing else was fitted.  One path, fixed
beforehand, leads through the cutoffs of a fixed grid: those of the first of RULES from the
loosest to the tightest, then, with that one as it is, those of the second, and so on.  A
place on the path passes if the exact binomial test rejects "more than ALPHA of the good
documents are rejected by the rules together", that is if the chance of as few false
rejections or fewer at that rate is at most DELTA / (strata + 1).  Testing ends at the
first failure, so that neither rules nor cutoffs need a correction of their own; strata
are corrected by Bonferroni.  With probability 1 - DELTA, then, all rules together reject
at most ALPHA of the good documents of every stratum that has labels enough for a test
of its own: n with (1 - ALPHA) ** n <= DELTA / (strata + 1).

A stratum with fewer labels takes the place that the labels of all strata pass together,
and goes back from it as long as more than ALPHA of its own are rejected.  For these the
bound holds for the good documents of all labelled strata taken together.  If all labels
are too few, or a stratum has none, documents are kept unless the base rule fails them.

Counts of good documents by stratum and place on the path are summed where they arise; a
stratum's test sees at most rules * grid counts.

Defined results: a null text has no words and fails the base rule; null is a stratum of
its own; rows that repeat a doc_id are judged each for itself, and a doc_id is good if
any of its labels says quality 1; without labels nothing but the base rule rejects.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.blocks import CHUNK_BYTES, SEPARATORS, chunks, kept, mix, powers, runs, tokenise

U = np.uint64
ALPHA, DELTA = 0.01, 0.05
GRID = 50  # cutoffs 1 / GRID, 2 / GRID, ... of each measure, which are shares
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share")
PATH = len(RULES) * (GRID - 1)  # places on the path; the tightest is 0
REPEAT_WINDOW = 5
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xC2B2AE3D27D4EB4F))
_SYMBOL, _UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and don't overlap."""
    out, at = np.zeros(len(starts), U), 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + CHUNK_BYTES, "right")))
        own = slice(at, to)
        n = int(ends[to - 1] - begin)
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTES[raw[begin : begin + n]] * powers(_BASE, n), out=sums[1:])
        out[own] = (sums[ends[own] - begin] - sums[starts[own] - begin]) * powers(_INVERSE, n + 1)[starts[own] - begin]
        at = to
    return mix(out + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def by_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text."""
    words = tokenise(texts)
    raw, offsets, n_docs = words.raw, words.offsets, len(words.first) - 1
    out = {"n_words": words.counts.astype(np.int64)}
    out["word_chars"] = by_doc(~SEPARATORS[raw] & ((raw & 0xC0) != 0x80), offsets)
    out["n_symbols"] = by_doc(_SYMBOL[raw], offsets)
    out["n_upper"], out["n_letters"] = by_doc(_UPPER[raw], offsets), by_doc(_LETTER[raw], offsets)
    # lines: a document's first byte and each byte after a \n begins one
    breaks = np.flatnonzero(raw == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < len(raw)]
    at = np.searchsorted(breaks, starts)
    stop = np.append(breaks, len(raw))[at]
    doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(stop, offsets[doc + 1])
    has_word = np.concatenate([[0], np.cumsum(~SEPARATORS[raw])])
    use = has_word[ends] > has_word[starts]
    starts, ends, doc = starts[use], ends[use], doc[use]
    h = span_hashes(raw, starts, ends)
    distinct = np.unique(np.stack([doc.astype(U), h]), axis=1)[0].astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct, minlength=n_docs)
    # words in windows that occur twice in a text
    window, keys = words.window_hashes(words.hashes(fold=False), REPEAT_WINDOW)
    keys = mix(keys ^ mix(words.doc[window].astype(U) + U(1)))
    order = np.argsort(keys, kind="stable")
    _, counts = runs(keys[order])
    twice = window[order[np.repeat(counts, counts) > 1]]
    cover = np.zeros(len(words.starts) + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = by_doc(np.cumsum(cover[:-1]) > 0, words.first)
    return out


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def document_stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the measures of docs(doc_id, text, stratum)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            stats = text_stats(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(stats[c], pa.int64()) for c in STATS)], ["doc_id", "stratum", *STATS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(stratum).cast("string").alias("stratum"))
    return rows.mapInArrow(measure, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in STATS))


def measures(stats: DataFrame) -> dict:
    """The shares that rules look at, 0 where there is nothing to share."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": F.least(share("n_symbols", "word_chars"), F.lit(1.0)),
        "upper_share": share("n_upper", "n_letters"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def at_most(k: int, n: int, p: float) -> float:
    """The chance of k successes or fewer in n trials of chance p, summed exactly."""
    if k >= n:
        return 1.0
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, exp(top) * sum(exp(x - top) for x in logs))


def tightest(above: list[int], n: int, alpha: float, delta: float) -> int | None:
    """The index of the tightest cutoff that passes; above[i]: good documents over the i-th cutoff, which ascend."""
    found = None
    for i in range(len(above) - 1, -1, -1):
        if n == 0 or above[i] > alpha * n or at_most(above[i], n, alpha) > delta:
            break
        found = i
    return found


def rejected_by(levels: list[int], counts: list[int]) -> tuple[list[int], int]:
    """How many documents each place on the path rejects, from the tightest to the loosest, and how many there are."""
    own = np.zeros(PATH + 1, np.int64)
    np.add.at(own, levels, counts)
    return (int(own.sum()) - np.cumsum(own)[:-1]).tolist(), int(own.sum())


def cutoffs_at(i: int | None) -> list[float | None]:
    """The cutoff of each rule at a place on the path."""
    if i is None:
        return [None] * len(RULES)
    later, step = divmod(i, GRID - 1)
    return [1 / GRID] * (len(RULES) - 1 - later) + [(step + 1) / GRID] + [None] * later


def select_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff for each rule; null where none passes."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    m = measures(stats)
    # a cell is the number of cutoffs below a document's measure, 1 more than that of its loosest cutoff
    cells = [F.least(F.ceil(m[r] * GRID), F.lit(GRID)).cast("int") for r in RULES]
    level = F.greatest(*(F.when(c > 1, c - 1 + k * (GRID - 1)).otherwise(0) for c, k in zip(cells, reversed(range(len(RULES))), strict=True)))
    counts = stats.join(good, "doc_id", "left_semi").select("stratum", level.alias("level")).groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    counts = kept(counts, "cutoff-counts")
    delta = delta / (counts.select("stratum").distinct().count() + 1)
    rows = counts.groupBy("level").agg(F.sum("n").alias("n")).collect()  # at most PATH + 1
    pooled, n_pooled = rejected_by([r.level for r in rows], [r.n for r in rows])
    common = tightest(pooled, n_pooled, alpha, delta)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        above, n = rejected_by(pdf["level"].tolist(), pdf["n"].tolist())
        if at_most(0, n, alpha) <= delta:
            i = tightest(above, n, alpha, delta)
        else:
            i = common
            while i is not None and above[i] > alpha * n:
                i = i + 1 if i + 1 < PATH else None
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]]} | {r: [c] for r, c in zip(RULES, cutoffs_at(i), strict=True)})

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def apply_rules(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """stats with base_failed and kept."""
    m = measures(stats)
    limits = cutoffs.select(F.col("stratum").alias("_s"), *(F.col(r).alias(f"_{r}") for r in RULES))
    over = [F.coalesce(m[r] > F.col(f"_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0] | over[1] | over[2] | over[3]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    joined = stats.join(limits, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_s", *(f"_{r}" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """Measures and verdict of each row of docs."""
    stats = kept(document_stats(docs, stratum), "stats")
    return apply_rules(stats, select_cutoffs(stats, labels, alpha, delta))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")
