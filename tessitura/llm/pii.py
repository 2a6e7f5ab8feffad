"""Personal data: patterns, and terms that disclose what they found (operator 7).

Pattern spans (e-mail and IP addresses, card and phone numbers) are the protected
entities.  A term of a document discloses an entity of it if seeing the term says almost who it
is.  With n documents, n_e that hold the entity, n_t that hold the term and n_et that hold both,
anywhere in their texts,

    PMI = log2(n * n_et / (n_e * n_t))      IC = log2(n / n_e)

and the term is a span if PMI >= DISCLOSURE * IC still holds with UNSEEN more
documents in n_t: as if one more had the term and not the entity.  This keeps words out that
disclose everything only in appearance, because they are seen once in a small corpus, and
leaves no entity out for being rare: one in a single document has terms from 2 ** 10 documents on.
A term is marked wherever it stands in the texts that hold the entity.  If its ratio PMI / IC is at least
REMOVAL its kind is ``removed`` and ``sanitise`` leaves it out; else it is ``generalised`` and
``sanitise`` puts something broader in its place: a decade for a year, the number of digits for
another number, or what sort of word it is.  Patterns become the name of their kind.

Co-occurrence is not counted for all words and entities.  As n_et is at most n_e, only terms with

    n_t + UNSEEN <= n ** (1 - DISCLOSURE) * n_e ** DISCLOSURE

can disclose; the words of texts with entities meet the document frequencies of all words of
all documents first, and only those that are rare enough come back.  Entities that are in the
same documents have the same terms and are one class, so that a text with many entities of its
own counts as one with one.

Patterns run in linear time, also on very long texts: a digit pattern starts at the first digit
of a run only (any later start in the run would fail as well), and an e-mail address is grown to the
left of its @.

Defined results: a null or empty text has no spans; rows with a null doc_id are scanned like any
other; rows that repeat another get equal spans and count as documents of their own; of
several ratios that a term has by several entities of a text the largest counts.  Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.llm.blocks import PACKED, buckets_for, chunks, exchange, join_by_count, kept, runs, scatter, sorted_sets, text_bytes, tokenise, unpack
from tessitura.llm.word_counts import packed_counts

U = np.uint64
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
DISCLOSURE, REMOVAL, UNSEEN = 0.9, 0.98, 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the pattern spans, in this order."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m.group())) <= 15]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    return sorted(found)


def word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    flat = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64)
    return flat[::2], flat[1::2]


def outside(begins: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of some words shares no character with any of the spans, which are in order."""
    if not spans:
        return np.ones(len(begins), bool)
    first = np.array([a for a, _, _ in spans])
    furthest = np.maximum.accumulate([b for _, _, b in spans])  # of the spans up to each
    before = np.searchsorted(first, ends)  # how many begin before the word's end
    return (before == 0) | (furthest[np.maximum(before - 1, 0)] <= begins)


FOUND = "doc_id long, row_key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, text string, entities array<long>"


MARKS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """The pattern spans of each row of docs(doc_id, text); if there are any, the text and the entities."""
    schema = T._parse_datatype_string(FOUND)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw, offsets = text_bytes(batch.column(1))
            mark = (raw >= 48) & (raw <= 57) | (raw == 64)  # no span is without a digit or an @
            some = np.diff(np.concatenate([[0], np.cumsum(mark)])[offsets]) > 0
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                spans, entities, text = [], {}, None
                own = raw[offsets[i] : offsets[i + 1]].tobytes()
                if some[i]:
                    text = own.decode()
                    spans = pattern_spans(text)
                for a, k, b in spans:
                    entities[xxhash.xxh3_64_intdigest(f"{k}:{text[a:b].lower()}".encode()) >> 1] = True
                counts = [sum(k == j for _, k, _ in spans) for j in range(4)]
                rows.append(
                    (
                        doc_id, f"{doc_id}:{xxhash.xxh3_128_hexdigest(own)}", *counts, hashlib.sha256(span_text(spans).encode()).hexdigest(),
                        [{"start": a, "kind": k, "end": b} for a, k, b in spans], text if spans else None, list(entities),
                    )
                )
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def term_hashes(text: str) -> np.ndarray:
    """The hash of each word, without its lowest bit."""
    return tokenise(pa.array([text], pa.string())).hashes(fold=True) >> U(1)


def entity_rows(found: DataFrame) -> DataFrame:
    """row, row_key, times, text, base and entities of each different row of found that has entities."""
    first = [F.first(c).alias(c) for c in ("text", "base", "entities")]
    some = found.where("size(entities) > 0").groupBy("row_key").agg(F.count(F.lit(1)).alias("times"), *first)
    return kept(some.withColumn("row", F.monotonically_increasing_id()), "entity-rows")


def entity_classes(rows: DataFrame) -> DataFrame:
    """row, times, class and n_e: the entities of each row, those in the same rows taken together."""
    held = rows.select("row", "times", F.explode("entities").alias("entity"))
    sums = held.groupBy("entity").agg(
        F.sum("times").alias("n_e"), F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "row")).alias("y")
    )
    sums = kept(sums, "entities")
    joined = join_by_count(held, sums, "entity", "rows", sums.agg(F.sum("rows")).first()[0] or 0)
    f = lambda c: F.col(f"__found.{c}")
    return joined.select("row", "times", F.xxhash64(f("n_e"), f("x"), f("y")).alias("class"), f("n_e").alias("n_e")).dropDuplicates(["row", "class"])


def rare_words(rows: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """row, term and n_t, in how many documents it is, of the words of rows(row, most, text) that are in ``most`` documents or fewer."""

    def words(batch: pa.RecordBatch) -> np.ndarray:
        w = tokenise(batch.column(0))
        return sorted_sets(w.first, w.hashes(fold=True) >> U(1))[1]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = tokenise(batch.column(2))
            bounds, h = sorted_sets(w.first, w.hashes(fold=True) >> U(1))
            if len(h):
                each = np.diff(bounds)
                yield scatter(h, {"h": h, "row": np.repeat(batch.column(0).to_numpy(), each), "most": np.repeat(batch.column(1).to_numpy(), each)}, n)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, counted = [], []
        for batch in batches:
            for p in batch.column(batch.schema.get_field_index("payload")):
                x = unpack(p.as_buffer())
                (asked if "row" in x else counted).append(x)
        if not asked or not counted:
            return
        x = {c: np.concatenate([p[c] for p in asked]) for c in asked[0]}
        h, c = (np.concatenate([p[k] for p in counted]) for k in ("h", "c"))
        order = np.argsort(h, kind="stable")
        begins, _ = runs(h[order])
        total = np.add.reduceat(c[order], begins)
        n_t = total[np.searchsorted(h[order][begins], x["h"])]  # a word that is asked for is in a document
        use = n_t <= x["most"]
        if use.any():
            yield pa.RecordBatch.from_arrays([pa.array(x["row"][use]), pa.array(x["h"][use].astype(np.int64)), pa.array(n_t[use])], ["row", "term", "n_t"])

    asked = rows.select("row", "most", "text").mapInArrow(ask, PACKED)
    return exchange(packed_counts(docs.select("text"), words, n).unionByName(asked), n, answer, "row long, term long, n_t long")


def disclosing_terms(rows: DataFrame, docs: DataFrame, n_docs: int, parts: int, disclosure: float = DISCLOSURE, unseen: int = UNSEEN) -> DataFrame:
    """row and own, array<struct<term, ratio>>: the terms of a row that disclose an entity of it."""
    n = F.lit(float(max(n_docs, 1)))
    classes = kept(entity_classes(rows), "entity-classes")
    most = F.pow(n, F.lit(1 - disclosure)) * F.pow(F.col("n_e").cast("double"), F.lit(disclosure)) * (1 + 1e-9) - unseen
    limits = classes.groupBy("row").agg(F.max("n_e").alias("n_e")).select("row", most.alias("most")).where("most >= 1")
    words = rare_words(rows.select("row", "text").join(limits, "row"), docs, parts)
    pairs = words.join(classes, "row").where(F.col("n_t") <= most).select(F.struct("class", "term").alias("pair"), "row", "times", "n_e", "n_t")
    pairs = kept(pairs, "disclosure-pairs")
    counted = pairs.groupBy("pair").agg(F.sum("times").alias("n_et"), F.count(F.lit(1)).alias("rows"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    ic = F.log2(n / F.col("n_e"))
    ratio = lambda n_t: F.when(ic > 0, F.log2(n * F.col("n_et") / (F.col("n_e") * n_t)) / ic).otherwise(0.0)
    telling = kept(counted.where(ratio(F.col("n_t") + unseen) >= disclosure).select("pair", "rows", ratio(F.col("n_t")).alias("ratio")), "disclosing-terms")
    own = join_by_count(pairs.select("pair", "row"), telling, "pair", "rows", pairs.count()).where("__found is not null")
    best = own.groupBy("row", F.col("pair.term").alias("term")).agg(F.max("__found.ratio").alias("ratio"))
    return best.groupBy("row").agg(F.collect_list(F.struct("term", "ratio")).alias("own"))


def mark_terms(rows: DataFrame, own: DataFrame, removal: float = REMOVAL) -> DataFrame:
    """row_key and terms, the spans of the terms own(row, own) in each of rows."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                ratio = {x["term"]: x["ratio"] for x in terms}
                begins, ends = word_bounds(text)
                h = term_hashes(text)
                use = np.flatnonzero(np.isin(h, np.array(list(ratio), U)) & outside(begins, ends, [(s["start"], s["kind"], s["end"]) for s in base]))
                found = zip(begins[use].tolist(), ends[use].tolist(), (ratio[t] for t in h[use].tolist()), strict=True)
                marks.append([{"start": a, "kind": KINDS.index("removed" if r >= removal else "generalised"), "end": b, "ratio": r} for a, b, r in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, MARKS)], ["row_key", "terms"])

    texts = rows.join(own, "row").select("row_key", "text", "base", "own")
    return texts.mapInArrow(mark, "row_key string, terms array<struct<start:int,kind:int,end:int,ratio:double>>")


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, unseen: int = UNSEEN, removal: float = REMOVAL) -> DataFrame:
    """doc_id, row_key, counts of the patterns, base_sha256, and spans: array<struct<start, kind, end, ratio>>."""
    found = kept(detect(docs), "pii")
    rows = entity_rows(found)
    marked = mark_terms(rows, disclosing_terms(rows, docs, found.count(), buckets_for(docs), disclosure, unseen), removal)
    base = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(None).cast("double").alias("ratio")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,ratio:double>>")
    return found.join(marked, "row_key", "left").withColumn("spans", F.array_sort(F.concat(base, F.coalesce(F.col("terms"), none)))).drop("base", "text", "entities", "terms")


_YEAR, _NUMBER = re.compile(r"[12][0-9]{3}"), re.compile(r"[+-]?[0-9]+(?:[.,][0-9]+)*")


def generalise(term: str) -> str:
    """Something broader that a term is one of many cases of; signs around it stay out."""
    core = term.strip(".,;:!?()[]{}<>\"'")
    if _YEAR.fullmatch(core):
        return f"[{core[:3]}0s]"
    if _NUMBER.fullmatch(core):
        return f"[number of {sum(c.isdigit() for c in core)} digits]"
    if any(c.isdigit() for c in core):
        return "[code]"
    return "[name]" if core[:1].isupper() else "[word]"


def sanitise(text: str | None, spans: list) -> str:
    """text with each pattern span replaced by its kind, terms generalised, and those whose kind is ``removed`` left out."""
    out, at = [], 0
    for start, kind, end, ratio in spans:
        if start < at:  # within the last one
            end = max(end, at)
            at = end
            continue
        broader = f"[{KINDS[kind]}]" if ratio is None else "" if KINDS[kind] == "removed" else generalise(text[start:end])
        out += [text[at:start], broader]
        at = end
    return "".join([*out, (text or "")[at:]])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """docs(doc_id, text) with their texts sanitised, and the spans of the original texts."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("None")), F.lit(":"))
    spans = personal_data(docs, **options).dropDuplicates(["row_key"]).select("row_key", "spans")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [a + xxhash.xxh3_128_hexdigest((t or "").encode()) for a, t in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys)], ["doc_id", "text", "row_key"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [sanitise(t, [tuple(s.values()) for s in x or []]) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], ["doc_id", "text", "spans"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("own")).mapInArrow(key, "doc_id long, text string, row_key string")
    joined = keyed.join(spans.hint("shuffle_hash"), "row_key", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(clean, joined.schema)


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(k) for k in KINDS))
    texts = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(texts, ",").alias("spans"))
