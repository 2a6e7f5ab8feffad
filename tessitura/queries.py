"""The queries over the test tables, each with the SQL that must give the same rows.

``embeddings`` stand in for signals, scores, hidden states and voices, ``events`` for frames
and seconds, ``documents`` and ``conversations`` for texts and tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import arrays as A
from tessitura.functions import text as X
from tessitura.functions import tokens as K
from tessitura.operators import ranking, segment, speech, transcripts
from tessitura.sources.models import style_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LABELS = [f"label_{i}" for i in range(20)]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores, if it is so small that its files are in fewer splits than that; a larger one as it is read."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n, key) if size < n * (32 << 20) else df


def r6(c) -> F.Column:
    """Rounded as both engines print it; adds 0 to lose the sign of zero."""
    return F.round(c, 6) + F.lit(0.0)


def cells(df: DataFrame, keys: list[str], array, index: str = "idx", value: str = "value") -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(index, value)).withColumn(value, r6(F.col(value).cast("double")))


V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
R6 = "round({}, 6) + 0.0"
LABEL_SQL = "CASE WHEN {0} < 20 THEN 'label_' || {0} ELSE 'Class_' || {0} END"
SOFT = f"""WITH {V},
e AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v),
p AS (SELECT vec_id, v, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""
UNNEST = "SELECT {keys}, (generate_subscripts({a}, 1) - 1)::INT AS {i}, round(unnest({a})::DOUBLE, 6) + 0.0 AS {v} FROM {t}"


# search and scores


@query(f"""
WITH {V}, q AS (SELECT v AS q FROM v ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM v, q ORDER BY similarity DESC, vec_id LIMIT 10
""")
def similarity_topk(spark, sf_dir):
    """The ten vectors most like the first one."""
    v = vectors(spark, sf_dir)
    first = v.orderBy("vec_id").limit(1).collect()
    return ranking.similarity_topk(v, first[0].v if first else [0.0], "vec_id", "v")


@query(f"""
WITH {V}
SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id
""")
def pairwise_similarity(spark, sf_dir):
    return ranking.pairwise_similarity(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"""{SOFT}, b AS (SELECT vec_id, p, list_position(v, list_max(v)) - 1 AS i FROM p)
SELECT vec_id, {LABEL_SQL.format("i")} AS predicted_label, round(p[i + 1], 6) + 0.0 AS score FROM b""")
def softmax_classify(spark, sf_dir):
    best = vectors(spark, sf_dir).select("vec_id", A.softmax("v").alias("p"), A.argmax("v").alias("i"))
    return best.select("vec_id", A.label_lookup(LABELS, F.col("i")).alias("predicted_label"), r6(F.get("p", F.col("i"))).alias("score"))


@query(SOFT + UNNEST.format(keys=" vec_id", a="p", i="idx", v="prob", t="p"))
def softmax_probs(spark, sf_dir):
    return cells(vectors(spark, sf_dir), ["vec_id"], A.softmax("v"), value="prob")


@query(f"""{SOFT}, x AS (SELECT vec_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS prob FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, i)::INT AS rank FROM x)
SELECT vec_id, rank, {LABEL_SQL.format("i")} AS label, round(prob, 6) + 0.0 AS probability FROM r WHERE rank <= 5""")
def label_topk5(spark, sf_dir):
    best = ranking.label_topk(vectors(spark, sf_dir), "vec_id", "v", LABELS, 5)
    return best.withColumn("probability", r6(F.col("probability")))


@query(f"""WITH {V} SELECT vec_id, (list_position(v, list_max(v)) - 1)::INT AS token FROM v""")
def greedy_decode(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", A.argmax("v").alias("token"))


@query(f"""WITH {V}, s AS (SELECT vec_id, list_transform(v, lambda x: x / 0.7) AS v FROM v),
e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM s),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p, (vec_id * 37 % 100) / 100.0::DOUBLE AS u FROM e),
x AS (SELECT vec_id, u, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS p FROM p),
c AS (SELECT vec_id, u, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) AS c FROM x)
SELECT vec_id, coalesce(min(i) FILTER (WHERE c >= u), max(i))::INT AS token FROM c GROUP BY vec_id""")
def sample_token(spark, sf_dir):
    u = (F.col("vec_id") * 37 % 100) / 100.0
    return vectors(spark, sf_dir).select("vec_id", A.sample_token("v", u, 0.7).alias("token"))


# pooling


STRIDED = "SELECT vec_id, (i % 8)::INT AS dim, {} AS value FROM x GROUP BY vec_id, i % 8"
CELLS = f"WITH {V}, x AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM v) "


@query(CELLS + STRIDED.format("round(avg(x), 6) + 0.0"))
def mean_pool(spark, sf_dir):
    return cells(vectors(spark, sf_dir), ["vec_id"], A.mean_pool("v", 8), "dim")


@query(CELLS + STRIDED.format("round(max(x), 6) + 0.0"))
def max_pool(spark, sf_dir):
    return cells(vectors(spark, sf_dir), ["vec_id"], A.max_pool("v", 8), "dim")


@query(CELLS + "SELECT vec_id, i::INT AS dim, round(x, 6) + 0.0 AS value FROM x WHERE i < 8")
def cls_pool(spark, sf_dir):
    return cells(vectors(spark, sf_dir), ["vec_id"], A.cls_pool("v", 8), "dim")


POOLED = CELLS + ", p AS (SELECT vec_id, i % 8 AS dim, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM p GROUP BY vec_id)"


@query(POOLED + " SELECT vec_id, dim::INT AS dim, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) + 0.0 AS value FROM p JOIN n USING (vec_id)")
def l2_normalize(spark, sf_dir):
    pooled = vectors(spark, sf_dir).select("vec_id", A.mean_pool("v", 8).alias("p"))
    return cells(pooled, ["vec_id"], A.l2_normalize("p"), "dim")


@query(POOLED + f""", l AS (SELECT vec_id, list(CASE WHEN n > 0 THEN x / n ELSE x END ORDER BY dim) AS v FROM p JOIN n USING (vec_id) GROUP BY vec_id),
e AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM l),
b AS (SELECT vec_id, e, list_position(v, list_max(v)) - 1 AS i FROM e)
SELECT vec_id, {LABEL_SQL.format("i")} AS predicted_label, round(e[i + 1] / list_sum(e), 6) + 0.0 AS score FROM b""")
def pooled_pipeline(spark, sf_dir):
    """Pool, normalise, classify."""
    v = vectors(spark, sf_dir).select("vec_id", A.l2_normalize(A.pool("v", 8, "mean")).alias("v"))
    best = v.select("vec_id", A.softmax("v").alias("p"), A.argmax("v").alias("i"))
    return best.select("vec_id", A.label_lookup(LABELS, F.col("i")).alias("predicted_label"), r6(F.get("p", F.col("i"))).alias("score"))


# pieces of signals


PIECE = "{} AS n_samples, round(list_sum(c), 6) + 0.0 AS total"


def summed(df: DataFrame, *columns) -> DataFrame:
    return df.select("vec_id", *columns, F.size("content").alias("n_samples"), r6(A.total(F.col("content"))).alias("total"))


@query(f"""WITH {V}, c AS (SELECT vec_id, i, v[i * 24 + 1 : i * 24 + 24] AS c FROM v, range(3) t(i))
SELECT vec_id, i::INT AS segment_index, round(i * 1.5::DOUBLE, 6) AS start_sec, round((i * 24 + len(c)) / 16.0::DOUBLE, 6) AS end_sec, len(c)::INT AS n_samples, round(list_sum(c), 6) + 0.0 AS total FROM c""")
def segment_audio(spark, sf_dir):
    pieces = segment.segment_audio(vectors(spark, sf_dir), "v", 16, 1.5)
    return summed(pieces, "segment_index", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


@query(f"""WITH {V}, c AS (SELECT vec_id, i, v[i * 16 + 1 : i * 16 + 24] AS c FROM v, range(4) t(i) WHERE i = 0 OR i * 16 - 16 + 24 <= 64)
SELECT vec_id, i::INT AS chunk_index, (i * 16)::INT AS "offset", len(c)::INT AS n_samples, round(list_sum(c), 6) + 0.0 AS total FROM c""")
def chunk_overlapped(spark, sf_dir):
    return summed(segment.chunk_overlapped(vectors(spark, sf_dir), "v", 24, 8), "chunk_index", "offset")


@query(f"""WITH {V}, c AS (SELECT vec_id, i, v[i * 24 + 1 : i * 24 + 24] AS c FROM v, range(2) t(i))
SELECT vec_id, i::INT AS frame, len(c)::INT AS n_samples, round(list_sum(c), 6) + 0.0 AS total FROM c""")
def frame_windows(spark, sf_dir):
    return summed(segment.frame_windows(vectors(spark, sf_dir), "v", 24), "frame")


FIT = "SELECT vec_id, {n} AS expected, i::INT AS idx, round(coalesce(v[i + 1], 0.0), 6) + 0.0 AS value, 8 > {n} AS is_longer FROM v, range({n} * 8) t(i)"


@query(f"WITH {V} " + FIT.format(n=6) + " UNION ALL " + FIT.format(n=10))
def fit_frames(spark, sf_dir):
    out = []
    for n in (6, 10):
        fitted, longer = A.fit_frames("v", 8, n)
        out.append(cells(vectors(spark, sf_dir).select("vec_id", F.lit(n).alias("expected"), longer.alias("is_longer"), fitted.alias("f")), ["vec_id", "expected", "is_longer"], F.col("f")))
    return out[0].unionByName(out[1])


@query(CELLS + "SELECT vec_id, (i % 8)::INT AS bin, (i // 8)::INT AS frame, round(x, 6) + 0.0 AS value FROM x")
def transpose_features(spark, sf_dir):
    t = vectors(spark, sf_dir).select("vec_id", A.transpose(A.rows_of("v", 8), 8).alias("t"))
    return cells(t.select("vec_id", F.posexplode("t").alias("bin", "row")), ["vec_id", "bin"], F.col("row"), "frame")


@query(f"""WITH {V}, i AS (SELECT vec_id, v, i, i * (64.0::DOUBLE / 24.0::DOUBLE) AS p FROM v, range(24) t(i))
SELECT vec_id, i::INT AS idx, round(v[floor(p)::INT + 1] * (1 - (p - floor(p))) + v[least(floor(p)::INT + 1, 63) + 1] * (p - floor(p)), 6) + 0.0 AS value FROM i""")
def resample_linear(spark, sf_dir):
    return cells(vectors(spark, sf_dir), ["vec_id"], A.resample_linear("v", 64, 24))


@query(CELLS + "SELECT vec_id, (i // 2)::INT AS idx, round(avg(x), 6) + 0.0 AS value FROM x GROUP BY vec_id, i // 2")
def to_mono(spark, sf_dir):
    return cells(vectors(spark, sf_dir), ["vec_id"], A.to_mono("v", 2))


@query(CELLS + "SELECT vec_id, i::INT AS idx, trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) * 32767)::INT AS value FROM x")
def pcm16_quantize(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(F.transform("v", A.pcm16)).alias("idx", "value"))


@query(CELLS + "SELECT vec_id, round(max(abs(x - trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) * 32767) / 32767.0::DOUBLE)), 9) AS max_error FROM x GROUP BY vec_id")
def pcm_roundtrip_error(spark, sf_dir):
    error = F.transform("v", lambda x: F.abs(x - A.from_pcm16(A.pcm16(x))))
    return vectors(spark, sf_dir).select("vec_id", F.round(F.array_max(error), 9).alias("max_error"))


@query(f"""WITH {V}, s AS (SELECT vec_id, list_transform(v, lambda x: x * 5) AS v FROM v),
p AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS p FROM s), x AS (SELECT vec_id, p, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM p)
SELECT vec_id, i::INT AS idx, round(CASE WHEN p > 1 THEN x / p ELSE x END, 6) + 0.0 AS value FROM x WHERE i < 59""")
def peak_normalize_trim(spark, sf_dir):
    """Peak normalisation, then five samples off the end."""
    loud = F.transform("v", lambda x: x * 5)
    return cells(vectors(spark, sf_dir), ["vec_id"], A.trim_end(A.peak_normalize(loud), 5))


@query(f"WITH {V} " + UNNEST.format(keys="vec_id", a="v", i="idx", v="value", t="v"))
def concat_audio(spark, sf_dir):
    """Segments joined again are the signal."""
    pieces = segment.segment_audio(vectors(spark, sf_dir), "v", 16, 1.5)
    return cells(segment.concat_audio(pieces, "vec_id", "segment_index", "content"), ["vec_id"], F.col("samples"))


@query(CELLS + "SELECT vec_id, ((i % 16) * 4 + i // 16)::INT AS idx, (floor((x + 1) * 500)::INT + (i // 16) * 1024)::INT AS code FROM x")
def codec_flatten(spark, sf_dir):
    codes = F.transform(A.rows_of("v", 16), lambda book: F.transform(book, lambda x: F.floor((x + 1) * 500).cast("int")))
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(A.codec_flatten(codes, 1024)).alias("idx", "code"))


@query("""SELECT event_id, 4096 AS vocab_size, trunc(value * 24000)::INT // 320 AS frames_24k, trunc(value * 16000)::INT // 640 AS frames_16k FROM events""")
def codec_counts(spark, sf_dir):
    s = F.col("value").cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.lit(A.codec_vocab_size(4, 1024)).alias("vocab_size"), A.codec_frame_count(s, 24000, 320).alias("frames_24k"), A.codec_frame_count(s, 16000, 640).alias("frames_16k"))


@query(rf"""WITH {V}, n AS (SELECT max(vec_id) AS last FROM embeddings), d AS (SELECT doc_id, least(length(text) + length(regexp_replace(text, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')), last)::BIGINT AS row_idx FROM documents, n)
SELECT doc_id, row_idx, round(list_sum(v), 6) + 0.0 AS style_sum FROM d JOIN v ON v.vec_id = row_idx""")
def style_row_lookup(spark, sf_dir):
    """The row of a voice table by the length of a text, at most the last one."""
    styles = vectors(spark, sf_dir).select(F.col("vec_id").alias("row_idx"), "v")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return style_rows(docs, styles, X.utf16_length(F.col("text"))).select("doc_id", "row_idx", r6(A.total(F.col("v"))).alias("style_sum"))


@query(f"""WITH {V}, c AS (SELECT vec_id, i, v[i * 16 + 1 : i * 16 + 16] AS c FROM v, range(4) t(i)),
x AS (SELECT vec_id, i, generate_subscripts(c, 1) - 1 AS j, unnest(c) AS x FROM c), p AS (SELECT vec_id, i, j % 4 AS d, avg(x) AS x FROM x GROUP BY ALL),
l AS (SELECT vec_id, i, list(x ORDER BY d) AS e FROM p GROUP BY ALL), q AS (SELECT e AS q FROM l ORDER BY vec_id, i LIMIT 1)
SELECT vec_id, i::INT AS segment_index, round(list_cosine_similarity(e, q), 6) + 0.0 AS similarity FROM l, q WHERE NOT (vec_id = (SELECT min(vec_id) FROM v) AND i = 0)
ORDER BY similarity DESC, vec_id, i LIMIT 5""")
def chunk_embed_search(spark, sf_dir):
    """Segments, an embedding of each, and those most like the first segment."""
    pieces = segment.segment_audio(vectors(spark, sf_dir), "v", 16, 1.0)
    embedded = pieces.select("vec_id", "segment_index", A.mean_pool("content", 4).alias("e"))
    found = embedded.orderBy("vec_id", "segment_index").limit(1).collect()
    target = F.array(*(F.lit(x) for x in found[0].e)) if found else F.array(F.lit(0.0))
    scored = embedded.where(~((F.col("vec_id") == found[0].vec_id) & (F.col("segment_index") == found[0].segment_index))) if found else embedded
    return scored.select("vec_id", "segment_index", r6(A.cosine_similarity("e", target)).alias("similarity")).orderBy(F.desc("similarity"), "vec_id", "segment_index").limit(5)


# speech segments

FRAME = 0.032


def frames(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("frame"), (F.col("value") / (F.col("value") + 50)).alias("prob"))


#: Islands by another road than the windows of the operator: runs of equal speech flags, then gaps.
ISLANDS = """
f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / (value + 50) AS prob FROM events),
n AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id),
s AS (SELECT user_id, frame, lag(frame) OVER (PARTITION BY user_id ORDER BY frame) AS prev FROM f WHERE prob >= 0.5),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR frame - prev - 1 >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM s),
i0 AS (SELECT user_id, island, min(frame) AS start_frame, max(frame) AS last FROM g GROUP BY user_id, island),
i AS (SELECT user_id, island, start_frame, CASE WHEN n - 1 - last BETWEEN 1 AND 3 THEN n - 1 ELSE last END AS end_frame, n FROM i0 JOIN n USING (user_id)),
c AS (SELECT i.user_id, i.island, start_frame, end_frame, n, avg(prob) AS confidence FROM i JOIN f ON f.user_id = i.user_id AND f.frame BETWEEN start_frame AND end_frame GROUP BY ALL),
t AS (SELECT *, round(greatest(0.0::DOUBLE, start_frame * 0.032::DOUBLE - 0.03::DOUBLE), 7) AS st, round(least(n * 0.032::DOUBLE, (end_frame + 1) * 0.032::DOUBLE + 0.03::DOUBLE), 7) AS en FROM c),
seg AS (SELECT * FROM t WHERE round(en - st, 7) >= 0.25)
"""


@query("WITH " + ISLANDS + "SELECT user_id, island::INT AS island, start_frame::INT AS start_frame, end_frame::INT AS end_frame FROM c")
def vad_segments(spark, sf_dir):
    found = speech.speech_islands(frames(spark, sf_dir), "user_id", "frame", "prob")
    return found.select("user_id", F.col("island").cast("int").alias("island"), F.col("start_frame").cast("int").alias("start_frame"), F.col("end_frame").cast("int").alias("end_frame"))


def segments(spark, sf_dir) -> DataFrame:
    return speech.speech_segments(frames(spark, sf_dir), "user_id", "frame", "prob", FRAME)


@query("WITH " + ISLANDS + "SELECT user_id, island::INT AS island, round(st, 6) AS start_sec, round(en, 6) AS end_sec, round(confidence, 6) AS confidence FROM seg")
def vad_confidence(spark, sf_dir):
    return segments(spark, sf_dir).select("user_id", F.col("island").cast("int").alias("island"), F.round("start", 6).alias("start_sec"), F.round("end", 6).alias("end_sec"), F.round("confidence", 6).alias("confidence"))


SUMMARY = ", u AS (SELECT DISTINCT user_id FROM events), y AS (SELECT user_id, count(*) AS k, sum(en - st) AS t, min(st) AS a, max(en) AS b, avg(confidence) AS c FROM seg GROUP BY user_id)"


@query("WITH " + ISLANDS + SUMMARY + " SELECT user_id, coalesce(k, 0)::INT AS segment_count, round(coalesce(t, 0.0), 6) AS total_seconds, round(a, 6) AS first_start, round(b, 6) AS last_end, round(c, 6) AS mean_confidence FROM u LEFT JOIN y USING (user_id)")
def vad_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    s = speech.speech_summary(events, segments(spark, sf_dir), "user_id")
    mean = A.total(F.col("SegmentConfidences")) / F.nullif(F.size("SegmentConfidences"), F.lit(0))
    return s.select("user_id", F.col("SegmentCount").cast("int").alias("segment_count"), F.round("TotalSpeechSeconds", 6).alias("total_seconds"), F.round(F.array_min("SegmentStarts"), 6).alias("first_start"), F.round(F.array_max("SegmentEnds"), 6).alias("last_end"), F.round(mean, 6).alias("mean_confidence"))


@query("WITH " + ISLANDS + SUMMARY + " SELECT user_id, round(coalesce(t, 0.0) / (n * 0.032::DOUBLE), 6) AS speech_ratio FROM n LEFT JOIN y USING (user_id)")
def speech_ratio(spark, sf_dir):
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count(F.lit(1)) * F.lit(FRAME)).alias("seconds"))
    spoken = segments(spark, sf_dir).groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("t"))
    return lengths.join(spoken, "user_id", "left").select("user_id", F.round(F.coalesce("t", F.lit(0.0)) / F.col("seconds"), 6).alias("speech_ratio"))


@query("WITH " + ISLANDS + "SELECT c.user_id, c.island::INT AS island, count(*)::INT AS n_frames, round(sum(prob), 6) AS prob_sum FROM c JOIN f ON f.user_id = c.user_id AND f.frame BETWEEN c.start_frame AND c.end_frame GROUP BY ALL")
def vad_chunks(spark, sf_dir):
    """The frames of each island, cut out of the stream."""
    f = frames(spark, sf_dir)
    streams = f.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("frame", "prob"))).alias("a")).select("user_id", F.transform("a", lambda x: x["prob"]).alias("samples"))
    islands = speech.speech_islands(f, "user_id", "frame", "prob").select("user_id", "island", F.col("start_frame").cast("double").alias("start"), (F.col("end_frame") + 1).cast("double").alias("end"))
    chunks = speech.speech_chunks(streams, islands, "user_id", "samples", 1)
    return chunks.select("user_id", F.col("island").cast("int").alias("island"), F.size("content").alias("n_frames"), F.round(A.total(F.col("content")), 6).alias("prob_sum"))


# recogniser tokens


@query("""SELECT event_id, (least(greatest(round_even(value / 0.02::DOUBLE, 0), 0), 1500) + 50362)::INT AS token,
round(least(greatest(round_even(value / 0.02::DOUBLE, 0), 0), 1500) * 0.02::DOUBLE, 6) AS seconds FROM events""")
def timestamp_tokens(spark, sf_dir):
    token = K.seconds_to_token(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", token.alias("token")).withColumn("seconds", F.round(K.token_to_seconds(F.col("token")), 6))


@query("""WITH l AS (SELECT * FROM (VALUES ('en', 50259), ('de', 50261), ('es', 50262), ('fr', 50265)) l(lang, id))
SELECT doc_id, '50258' || coalesce(',' || id, '') || ',50358' AS prompt FROM documents LEFT JOIN l USING (lang)""")
def whisper_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(K.whisper_prompt("lang").cast("array<string>"), ",").alias("prompt"))


VOCAB = {i: f" w{i}" for i in range(1000)}


def token_lists(spark, sf_dir) -> DataFrame:
    """For each conversation, turn by turn: a time, the lengths of the text's words as ids, another time; then the end and a stray word."""
    words = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.least(F.length(w), F.lit(999)))
    start = (F.lit(50362) + F.col("turn") * 100).cast("int")
    turn = F.concat(F.array(start), words, F.array((start + 50).cast("int")))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("ids")))).alias("t"))
    return turns.select("conv_id", F.concat(F.flatten(F.transform("t", lambda x: x["ids"])), F.array(F.lit(50257), F.lit(7))).alias("token_ids"))


TURNS = """t AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM conversations),
x AS (SELECT conv_id, turn, coalesce(' ' || list_aggregate(list_transform(w, lambda y: 'w' || least(length(y), 999)), 'string_agg', ' '), '') AS text, len(w) AS n FROM t)"""


def recognised(spark, sf_dir) -> DataFrame:
    t = token_lists(spark, sf_dir)
    return t.select("conv_id", "token_ids", K.whisper_decode("token_ids", VOCAB).alias("text"), K.whisper_segments("token_ids", VOCAB).alias("segments"))


@query(f"WITH {TURNS} SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx, trim(text) AS text, round(turn * 2.0::DOUBLE, 6) AS start_sec, round(turn * 2.0::DOUBLE + 1, 6) AS end_sec FROM x WHERE trim(text) <> ''")
def whisper_segments(spark, sf_dir):
    s = recognised(spark, sf_dir).select("conv_id", F.posexplode("segments").alias("idx", "s"))
    return s.select("conv_id", "idx", "s.text", F.round("s.start", 6).alias("start_sec"), F.round("s.end", 6).alias("end_sec"))


@query(f"""WITH {TURNS} SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text,
string_agg('[' || printf('%.2f', turn * 2.0::DOUBLE) || 's]' || text || '[' || printf('%.2f', turn * 2.0::DOUBLE + 1) || 's]', '' ORDER BY turn) AS timed FROM x GROUP BY conv_id""")
def whisper_decode(spark, sf_dir):
    t = token_lists(spark, sf_dir)
    return t.select("conv_id", K.whisper_decode("token_ids", VOCAB).alias("text"), K.whisper_decode_timestamps("token_ids", VOCAB).alias("timed"))


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, trim(text) AS text, turn * 2.0::DOUBLE AS a, turn * 2.0::DOUBLE + 1 AS b FROM x WHERE trim(text) <> ''),
c AS (SELECT DISTINCT conv_id FROM x), n AS (SELECT conv_id, coalesce(max(seq), 0) AS n FROM c LEFT JOIN s USING (conv_id) GROUP BY conv_id)
SELECT conv_id, 0 AS seq, 'SessionOpen' AS kind, NULL AS text, NULL::DOUBLE AS start_sec FROM c
UNION ALL SELECT conv_id, seq::INT, 'TextUpdated', text, round(a, 6) FROM s
UNION ALL SELECT conv_id, 1, 'TextUpdated', '', NULL FROM n WHERE n = 0
UNION ALL SELECT conv_id, (greatest(n, 1) + 1)::INT, 'SessionClose', NULL, NULL FROM n""")
def stt_update_log(spark, sf_dir):
    log = transcripts.update_log(recognised(spark, sf_dir), "conv_id")
    return log.select("conv_id", "seq", "kind", "text", F.round("start", 6).alias("start_sec"))


@query(f"""WITH {TURNS}, s AS (SELECT conv_id, turn, trim(text) <> '' AS full_, n FROM x)
SELECT conv_id, round(min(turn * 2.0::DOUBLE) FILTER (WHERE full_), 6) AS start_sec, round(max(turn * 2.0::DOUBLE + 1) FILTER (WHERE full_), 6) AS end_sec,
count(*) FILTER (WHERE full_)::INT AS n_segments, (sum(n + 2) + 2)::INT AS n_tokens FROM s GROUP BY conv_id""")
def stt_response(spark, sf_dir):
    r = transcripts.response(recognised(spark, sf_dir), "conv_id")
    return r.select("conv_id", F.round("start", 6).alias("start_sec"), F.round("end", 6).alias("end_sec"), "n_segments", "n_tokens")


MARKED = "'<|startoftranscript|> <|en|><|0.00|>' || {t} || '<|1.00|>  <|nospeech|> tail <|endoftext|> <|open'"


@query(f"""SELECT doc_id, regexp_replace(regexp_replace({MARKED.format(t="text")}, '<\\|[^>]*?\\|>', '', 'gs'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM documents""")
def clean_transcription(spark, sf_dir):
    marked = F.concat(F.lit("<|startoftranscript|> <|en|><|0.00|>"), F.col("text"), F.lit("<|1.00|>  <|nospeech|> tail <|endoftext|> <|open"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_transcription(marked).alias("cleaned"))


# texts

SENTENCES = r"""p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents)"""
PUNCTUATED = "CASE WHEN {0} = '' OR regexp_matches({0}, '[.!?,;:]$') THEN {0} ELSE {0} || ',' END"


@query(f"""WITH {SENTENCES}, x AS (SELECT doc_id, len(p)::INT AS chunk_count, (generate_subscripts(p, 1) - 1)::INT AS chunk_index, unnest(p) AS s FROM p)
SELECT doc_id, chunk_index, chunk_count, {PUNCTUATED.format("s")} AS content FROM x
UNION ALL SELECT doc_id, 0, 1, {PUNCTUATED.format("text")} FROM documents JOIN p USING (doc_id) WHERE len(p) = 0""")
def sentence_chunks(spark, sf_dir):
    chunks = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", X.sentence_chunks("text").alias("c"))
    return chunks.select("doc_id", F.size("c").alias("chunk_count"), F.posexplode("c").alias("chunk_index", "content"))


@query(rf"""WITH RECURSIVE {SENTENCES}, x AS (SELECT doc_id, generate_subscripts(p, 1) AS s, unnest(p) AS text FROM p),
w AS (SELECT doc_id, s, list_filter(string_split(text, ' '), lambda y: y <> '') AS w FROM x WHERE length(text) + CASE WHEN regexp_matches(text, '[.!?,;:]$') THEN 0 ELSE 1 END > 80),
k AS (SELECT doc_id, s, w, 1 AS i, 0 AS chunk, w[1] AS now FROM w WHERE len(w) > 0
  UNION ALL
  SELECT doc_id, s, w, i + 1, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN now || ' ' || w[i + 1] ELSE w[i + 1] END
  FROM (SELECT *, length(now) + 1 + length(w[i + 1]) + CASE WHEN regexp_matches(w[i + 1], '[.!?,;:]$') THEN 0 ELSE 1 END <= 80 AS fits FROM k WHERE i < len(w))),
c AS (SELECT doc_id, s, chunk, arg_max(now, i) AS c FROM k GROUP BY ALL
  UNION ALL SELECT doc_id, s, 0, text FROM x WHERE length(text) + CASE WHEN regexp_matches(text, '[.!?,;:]$') THEN 0 ELSE 1 END <= 80
  UNION ALL SELECT doc_id, 1, 0, text FROM documents JOIN p USING (doc_id) WHERE len(p) = 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s, chunk) - 1)::INT AS chunk_index, {PUNCTUATED.format("c")} AS content FROM c""")
def pack_words(spark, sf_dir):
    """Sentences of at most 80 characters, the longer ones packed by words."""
    chunks = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", X.sentence_chunks_arrow("text", 80).alias("c"))
    return chunks.select("doc_id", F.posexplode("c").alias("chunk_index", "content"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS p FROM documents)
SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS idx, unnest(p) AS paragraph FROM p""")
def paragraphs(spark, sf_dir):
    """Every line made a paragraph, and found again."""
    blank = F.replace("text", F.lit("\n"), F.lit("\r\n\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.paragraphs(blank)).alias("idx", "paragraph"))


NORMAL = r"list_aggregate(regexp_extract_all({}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]'), 'string_agg', ' ')"


@query(f"SELECT doc_id, coalesce({NORMAL.format('text')}, '') AS normalized FROM documents")
def phoneme_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.phoneme_normalize("text").alias("normalized"))


_SYMBOLS = "'" + X.PHONEMES.replace("'", "''") + "'"


@query(f"""WITH n AS (SELECT conv_id, turn, coalesce({NORMAL.format('text')}, '') AS t FROM conversations),
c AS (SELECT conv_id, turn, t, list_filter(list_transform(string_split(t, ''), lambda c: instr({_SYMBOLS}, c) - 1), lambda i: i >= 0) AS ids FROM n)
SELECT conv_id, turn, len(ids)::INT AS n_ids, coalesce(list_sum(ids), 0)::BIGINT AS id_sum, coalesce(list_aggregate(list_transform(list_filter(ids, lambda i: i > 0), lambda i: substr({_SYMBOLS}, (i + 1)::INT, 1)), 'string_agg', ''), '') AS decoded FROM c""")
def phoneme_encode(spark, sf_dir):
    ids = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id").select("conv_id", "turn", X.phoneme_encode("text").alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return ids.select("conv_id", "turn", F.size("ids").alias("n_ids"), total.alias("id_sum"), X.phoneme_decode("ids").alias("decoded"))


@query("""WITH b AS (SELECT DISTINCT unnest(string_split(replace(text, ' ', '▁'), '')) AS c FROM benchmark), v AS (SELECT c, row_number() OVER (ORDER BY encode(c)) + 3 AS id FROM b WHERE c NOT IN ('', '▁')),
m AS (SELECT '▁' AS c, 3 AS id UNION ALL SELECT * FROM v), n AS (SELECT conv_id, turn, '▁' || replace(text, ' ', '▁') AS t FROM conversations),
x AS (SELECT conv_id, turn, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM n),
y AS (SELECT conv_id, turn, i, x.c, coalesce(id, 0) AS id FROM x LEFT JOIN m ON m.c = x.c WHERE x.c <> '')
SELECT conv_id, turn, count(*)::INT AS n_ids, sum(id)::BIGINT AS id_sum, regexp_replace(replace(coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE id > 0), ''), '▁', ' '), '^ ', '') AS decoded FROM y GROUP BY conv_id, turn""")
def spm_char_encode(spark, sf_dir):
    """A character model of the characters of the benchmark."""
    used = table(spark, sf_dir, "benchmark").select(F.explode(X.characters(F.translate("text", " ", X.SPM_SPACE))).alias("c")).distinct().collect()
    vocab = {"<unk>": 0, "<s>": 1, "</s>": 2, X.SPM_SPACE: 3}
    vocab |= {c: i + 4 for i, c in enumerate(sorted({r.c for r in used} - {X.SPM_SPACE}))}
    ids = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id").select("conv_id", "turn", X.spm_char_encode("text", vocab).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x)
    return ids.select("conv_id", "turn", F.size("ids").alias("n_ids"), total.alias("id_sum"), X.spm_char_decode("ids", {v: k for k, v in vocab.items()}).alias("decoded"))


# streams of events, as batches


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("""WITH s AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, value FROM events), w AS (SELECT b AS window_start, value FROM s UNION ALL SELECT b - INTERVAL 30 MINUTE, value FROM s)
SELECT window_start, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY window_start""")
def events_sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("""WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")
def events_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n", "total")


# features and models


@query(f"""WITH {V}, x AS (SELECT vec_id, k, sum(v[i + 1] * cos(2 * pi() * k * i / 64)) AS re, sum(v[i + 1] * sin(2 * pi() * k * i / 64)) AS im FROM v, range(64) t(i), range(33) s(k) GROUP BY vec_id, k)
SELECT vec_id, k::INT AS k, round(re * re + im * im, 6) + 0.0 AS power FROM x""")
def dft_power(spark, sf_dir):
    """The power spectrum of each vector, by explicit sums."""
    return cells(vectors(spark, sf_dir), ["vec_id"], A.dft_power("v", 64), "k", "power")


#: Log-mel bands of one frame: a Hann window, a Fourier transform by sums, triangles.  n samples at 16 kHz, m bands.
MEL = """x AS (SELECT vec_id, k, sum(v[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / ({n} - 1))) * cos(2 * pi() * k * i / {n})) AS re,
  sum(v[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / ({n} - 1))) * sin(2 * pi() * k * i / {n})) AS im FROM s, range({n}) t(i), range({n} // 2 + 1) u(k) GROUP BY vec_id, k),
e AS (SELECT i, 700 * (10 ** (i * 2595 * log10(1 + 8000.0::DOUBLE / 700) / ({m} + 1) / 2595) - 1) AS f FROM range({m} + 2) t(i)),
b AS (SELECT l.i AS bin, l.f AS lo, c.f AS ce, h.f AS hi FROM e l JOIN e c ON c.i = l.i + 1 JOIN e h ON h.i = l.i + 2),
w AS (SELECT bin, k, greatest(0, least((k * 16000.0::DOUBLE / {n} - lo) / (ce - lo), (hi - k * 16000.0::DOUBLE / {n}) / (hi - ce))) AS w FROM b, range({n} // 2 + 1) u(k))
SELECT vec_id, bin::INT AS bin, round(ln(greatest(sum((re * re + im * im) * w), 1e-10)), {r}) + 0.0 AS value FROM x JOIN w USING (k) GROUP BY vec_id, bin"""


@query(f"WITH {V}, s AS (SELECT * FROM v), " + MEL.format(n=64, m=8, r=6))
def mel_frame(spark, sf_dir):
    """One log-mel frame of 8 bands of each vector."""
    from tessitura.functions.mel import MelOptions, mel_features

    made = spread(vectors(spark, sf_dir), "vec_id").select("vec_id", mel_features("v", MelOptions(bins=8, fft=64, hop=64, precise=True)).alias("f"))
    return cells(made, ["vec_id"], F.col("f.data"), "bin")


@query(f"WITH {V}, s AS (SELECT vec_id, list_transform(range(16), lambda j: ((v[4 * j + 1]::FLOAT + v[4 * j + 2]::FLOAT) / 2::FLOAT)::DOUBLE) AS v FROM v), " + MEL.format(n=16, m=4, r=6))
def stereo_features(spark, sf_dir):
    """Each vector as 32 frames of two channels at 32 kHz, mixed down and resampled to a model's 16 kHz by the feature stage."""
    from tessitura.functions.mel import MelOptions
    from tessitura.plans.stages import ExtractFeatures

    df = spread(vectors(spark, sf_dir), "vec_id").select("vec_id", "v", F.lit(32000).alias("rate"), F.lit(2).alias("width"))
    made = ExtractFeatures(MelOptions(bins=4, fft=16, hop=16, precise=True), "v", "f", source_rate="rate", channels="width").transform(df)
    return cells(made, ["vec_id"], F.col("f.data"), "bin")


@query("""SELECT r_regionkey, i::INT AS idx, round(sin(i * (2 * pi() / 8000 * 440)) * 0.3 + sin(i * (2 * pi() / 8000 * 880)) * 0.1, 6) + 0.0 AS tones,
round(sin(2 * pi() * (200 + 1800 * (i / 8000.0::DOUBLE) / 0.02::DOUBLE) * (i / 8000.0::DOUBLE)) * 0.5, 6) + 0.0 AS chirp, true AS quiet FROM region, range(160) t(i)""")
def signals(spark, sf_dir):
    """Tones, a rising one, and noise, whose samples are bounded."""
    both = F.arrays_zip(A.tones(160, 8000, [(440, 0.3), (880, 0.1)]).alias("tones"), A.chirp(160, 8000).alias("chirp"), A.noise(160, F.col("r_regionkey")).alias("noise"))
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(both).alias("idx", "s"))
    return rows.select("r_regionkey", "idx", r6(F.col("s.tones")).alias("tones"), r6(F.col("s.chirp")).alias("chirp"), (F.abs("s.noise") <= 0.3).alias("quiet"))


@query(f"""WITH {V}, b AS (SELECT vec_id, list_position(v, list_max(v)) - 1 AS i, v FROM v)
SELECT vec_id, {LABEL_SQL.format("i")} AS predicted_label, len(v)::INT AS n_probabilities FROM b""")
def classify_stage(spark, sf_dir):
    """Scores to labels by the stage that pipelines use."""
    from tessitura.plans.stages import SoftmaxLabel

    scores = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("Scores"))
    return SoftmaxLabel(LABELS).transform(scores).select("vec_id", F.col("PredictedLabel").alias("predicted_label"), F.size("Probabilities").alias("n_probabilities"))


WAV_KINDS = ((8, 1), (16, 1), (24, 1), (32, 3))


@query("""WITH x AS (SELECT vec_id, embedding AS v FROM embeddings),
s AS (SELECT vec_id, 8 AS bits, [(floor(y * 100) + 128 - 128)::DOUBLE / 128 FOR y IN v] AS v FROM x
UNION ALL SELECT vec_id, 16, [floor(y * 100) / 32767 FOR y IN v] FROM x UNION ALL SELECT vec_id, 24, [floor(y * 100) * 256 / 8388608 FOR y IN v] FROM x
UNION ALL SELECT vec_id, 32, [floor(y * 100) / 128 FOR y IN v] FROM x)
SELECT vec_id, bits::INT AS bits, i::INT AS idx, round((v[2 * i + 1] + v[2 * i + 2]) / 2, 6) + 0.0 AS value FROM s, range(32) t(i)""")
def wav_formats(spark, sf_dir):
    """Each vector as a stereo file of every sample format, mixed down as it is read."""
    from tessitura.sources.wav import decode_wav

    def little(x, n: int):
        """Hex digits of the n low bytes of a number, the lowest first."""
        return F.concat(*(F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)))

    def file(bits: int, kind: int):
        step = {8: lambda x: x + 128, 16: lambda x: x, 24: lambda x: x * 256}

        def sample(x):
            whole = F.floor(x * 100).cast("long")
            if kind == 1:
                return little(step[bits](whole), bits // 8)
            # a power of two below its size, and what is left over it, make the bits of a single
            size = F.abs(whole)
            power = F.length(F.bin(size)) - 1
            made = (F.when(whole < 0, F.lit(1 << 31)).otherwise(F.lit(0)).cast("long") + (power + F.lit(127 - 7)).cast("long") * (1 << 23) + (size * F.lit(1 << 23) / F.pow(F.lit(2.0), power)).cast("long") - (1 << 23))
            return little(F.when(whole == 0, F.lit(0).cast("long")).otherwise(made), 4)

        n = bits // 8
        head = b"WAVEfmt " + (16).to_bytes(4, "little") + b"".join(v.to_bytes(w, "little") for v, w in ((kind, 2), (2, 2), (16000, 4), (32000 * n, 4), (2 * n, 2), (bits, 2))) + b"data" + (64 * n).to_bytes(4, "little")
        return F.unhex(F.concat(F.lit((b"RIFF" + (len(head) + 64 * n).to_bytes(4, "little") + head).hex()), F.array_join(F.transform("embedding", sample), "")))

    files = F.explode(F.array(*(F.struct(F.lit(bits).alias("bits"), file(bits, kind).alias("content")) for bits, kind in WAV_KINDS))).alias("w")
    audio = table(spark, sf_dir, "embeddings").select("vec_id", files).select("vec_id", "w.bits", decode_wav("w.content").alias("a"))
    return cells(audio, ["vec_id", "bits"], F.col("a.samples"), "idx")


@query("""SELECT vec_id, len(embedding) / 16000.0::DOUBLE AS seconds, 8::INT AS frames, 8::INT AS dim, 1::INT AS one_frame, len(embedding)::INT AS one_dim, 64::INT AS flat FROM embeddings""")
def duration_shape(spark, sf_dir):
    """Seconds of each vector, the shape that a model's input makes of it, and the size of its rows put together again."""
    df = table(spark, sf_dir, "embeddings")
    shape, plain = A.infer_shape("embedding", (1, -1, 8)), A.infer_shape("embedding", (-1, -1))
    flat = F.size(A.flatten_rows(A.rows_of("embedding", 8)))
    return df.select("vec_id", A.duration("embedding", 16000).alias("seconds"), shape["frames"].alias("frames"), shape["dim"].alias("dim"), plain["frames"].alias("one_frame"), plain["dim"].alias("one_dim"), flat.alias("flat"))


@query(f"""WITH {V}, p AS (SELECT vec_id, [list_avg([v[f * 8 + j + 1] FOR f IN range(8)]) FOR j IN range(8)] AS p FROM v),
n AS (SELECT vec_id, p, sqrt(list_sum([x * x FOR x IN p])) AS n FROM p)
SELECT vec_id, j::INT AS idx, round((p[j + 1] / n)::FLOAT::DOUBLE, 6) + 0.0 AS value FROM n, range(8) t(j)""")
def embed_stage(spark, sf_dir):
    """Hidden states to embeddings of length one by the stage that pipelines use."""
    from tessitura.plans.stages import Pool

    states = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("Scores"))
    made = Pool("mean", True, hidden=8).transform(states)
    return cells(made, ["vec_id"], "Embedding")


WEIGHTS = [[(i * 7 + j * 3) % 5 - 2 for j in range(10)] for i in range(64)]


@query(f"""WITH {V} SELECT vec_id, j::INT AS idx, sum(floor(v[i + 1] * 256) / 256 * ((i * 7 + j * 3) % 5 - 2)) + 0.0 AS score FROM v, range(64) t(i), range(10) s(j) GROUP BY vec_id, j""")
def onnx_matmul_score(spark, sf_dir):
    """A model that multiplies by a matrix, run by the scorer."""
    from tessitura.scoring.onnx import onnx_score
    from tessitura.scoring.sessions import Model
    from tessitura.scoring.tiny import matmul

    exact = F.transform("v", lambda x: (F.floor(x * 256) / 256).cast("float"))  # sums of these are the same in single precision
    features = vectors(spark, sf_dir).select("vec_id", F.struct(exact.alias("data"), F.lit(1).alias("frames"), F.lit(64).alias("dim")).alias("Features"))
    scored = onnx_score(features, Model(matmul(WEIGHTS)))
    return scored.select("vec_id", F.posexplode("Scores").alias("idx", "score")).withColumn("score", F.col("score").cast("double") + F.lit(0.0))


@query(f"""WITH {V}, y AS (SELECT vec_id, j, sum(floor(v[i + 1] * 256) / 256 * ((i * 7 + j * 3) % 5 - 2)) AS y FROM v, range(64) t(i), range(10) s(j) GROUP BY vec_id, j),
b AS (SELECT vec_id, arg_max(j, (y, -j)) AS j FROM y GROUP BY vec_id)
SELECT vec_id, 'label_' || j AS predicted_label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS branch FROM b""")
def pipeline_branches(spark, sf_dir):
    """A composed pipeline: features, a branch for each half of the rows and their union, a model, its labels."""
    from tessitura.plans import stages
    from tessitura.scoring.sessions import Model
    from tessitura.scoring.tiny import matmul

    def branches(df: DataFrame) -> DataFrame:
        even = df.where("vec_id % 2 = 0").withColumn("branch", F.lit("even"))
        return even.unionByName(df.where("vec_id % 2 <> 0").withColumn("branch", F.lit("odd")))

    exact = F.transform("v", lambda x: (F.floor(x * 256) / 256).cast("float"))
    features = stages.Apply(lambda df: df.select("vec_id", F.struct(exact.alias("data"), F.lit(1).alias("frames"), F.lit(64).alias("dim")).alias("Features")), "v")
    made = stages.pipeline(features, stages.Apply(branches, "vec_id"), stages.Score(Model(matmul(WEIGHTS))), stages.SoftmaxLabel(LABELS))
    return made.transform(vectors(spark, sf_dir)).select("vec_id", F.col("PredictedLabel").alias("predicted_label"), "branch")


@query(f"""WITH RECURSIVE {V}, m AS (SELECT vec_id, i, list_sum(list_transform(v[i * 16 + 1 : i * 16 + 16], lambda x: abs(x))) / 16 AS m FROM v, range(4) t(i)),
s AS (SELECT vec_id, 0 AS frame, m AS c FROM m WHERE i = 0 UNION ALL SELECT s.vec_id, s.frame + 1, s.c / 2 + m.m FROM s JOIN m ON m.vec_id = s.vec_id AND m.i = s.frame + 1)
SELECT vec_id, frame::INT AS frame, round(c / (c + 1), 4) AS prob FROM s""")
def vad_recurrent_state(spark, sf_dir):
    """Frame probabilities of a model that carries its state from frame to frame."""
    from tessitura.plans.facades import VoiceActivity
    from tessitura.scoring.sessions import Model
    from tessitura.scoring.tiny import recurrent

    audio = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("Audio"))
    probs = VoiceActivity(Model(recurrent(16)), window=16).probabilities(audio)
    return probs.select("vec_id", F.posexplode("probs").alias("frame", "prob")).withColumn("prob", F.round(F.col("prob").cast("double"), 4))


@query("""SELECT vec_id, 16000 AS sample_rate, 64 AS n_samples, list_sum(list_transform(embedding, lambda x: trunc(greatest(-1::FLOAT, least(1::FLOAT, x)) * 32767::FLOAT)::BIGINT))::BIGINT AS total FROM embeddings""")
def wav_roundtrip(spark, sf_dir):
    """Each vector as a WAV file and back."""
    from tessitura.sources.wav import decode_wav, encode_wav

    files = table(spark, sf_dir, "embeddings").select("vec_id", encode_wav("embedding").alias("content"))
    audio = files.select("vec_id", decode_wav("content").alias("a"))
    return audio.select("vec_id", "a.sample_rate", F.size("a.samples").alias("n_samples"), A.total(F.transform(A.doubles(F.col("a.samples")), lambda x: F.round(x * 32767))).cast("long").alias("total"))
