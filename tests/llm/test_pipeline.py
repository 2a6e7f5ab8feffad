"""The stages of the pipeline, each against brute force on its own input."""

import re

from pyspark.sql import functions as F

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=str)


def test_stages(spark, small, rows):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    known = stages["language_id"](spark, docs, small)
    assert known.columns == docs.columns
    left = {r.doc_id for r in known.collect()}
    assert all(r[0] not in left for r in rows if r[0] not in (5, None) and not any(c.isalpha() for c in r[1] or ""))
    assert len(left) > 90

    first = stages["jaccard_join"](spark, docs, small)
    assert first.columns == docs.columns
    sets = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, r in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(low))
        sets[k] = (r[0], r[1], frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    linked = lambda x, y: x and y and 10 * len(x & y) >= 8 * len(x | y)
    reach = {k: {k} for k in sets}
    for a in sets:
        for b in sets:
            if a < b and None not in (sets[a][0], sets[b][0]) and linked(sets[a][2], sets[b][2]):
                both = reach[a] | reach[b]
                for x in both:
                    reach[x] = both
    lowest = {k: min((sets[x][0] for x in reach[k]), default=None) if sets[k][0] is not None else None for k in sets}
    expected = {(sets[k][0], sets[k][1]) for k in sets if sets[k][0] == lowest[k]}
    assert sorted(((r.doc_id, r.text) for r in first.collect()), key=str) == sorted(expected, key=str)

    clean = stages["decontamination"](spark, docs, small)
    from tessitura.llm.decontamination import find_matches

    hit = {r.doc_id for r in find_matches(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert hit and ids(clean) == sorted((r[0] for r in rows if r[0] not in hit), key=str)

    mixed = stages["mix_sources"](spark, docs, small)
    assert mixed.columns == docs.columns
    from tessitura.llm.mixing import copies_of, mixture, with_rates

    sized, rates = mixture(docs)
    n = with_rates(sized, rates, "source").agg(F.sum(copies_of(F.col("__r"), F.col("u")))).first()[0]
    assert mixed.count() == n

    placed = stages["shard"](spark, docs, small)
    assert placed.count() == len(rows)


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "shard", "slot"} <= set(out.columns)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert counts and max(counts) - min(counts) <= 1


def test_no_rows(spark, small, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert ids(dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, empty)) == ids(docs)
