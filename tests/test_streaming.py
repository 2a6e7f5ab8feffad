"""Streams against what the batch forms give."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessitura.operators.speech import speech_islands
from tessitura.sources.wav import Audio, encode
from tessitura.streaming import streams as S


def test_steps_match_islands(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for key in range(30):
        probs = [rng.choice([0.1, 0.2, 0.6, 0.9]) if rng.random() < 0.5 else rng.choice([0.1, 0.8]) * 0.9 for _ in range(rng.randint(0, 60))]
        rows += [(key, i, p) for i, p in enumerate(probs)]
        state, found = S._NEW, []
        while probs:
            n = rng.randint(1, 7)
            state, closed = S.step(state, probs[:n], 0.5, 4)
            found, probs = found + closed, probs[n:]
        expected += [(key, *s) for s in found + S.finish(state)]
    df = spark.createDataFrame(rows, "key int, frame long, prob double")
    got = [(r.key, r.start_frame, r.end_frame, r.confidence) for r in speech_islands(df, "key", "frame", "prob").collect()]
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(expected)]
    assert np.allclose([x[3] for x in sorted(got)], [x[3] for x in sorted(expected)])


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.sql(f"select * from {name}")


def test_wav_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(encode(Audio(np.sin(np.arange(64000) / 6).astype(np.float32) * 0.5)))
    (tmp_path / "in" / "b.wav").write_bytes(b"not a wav file")
    segments = run(S.stream_segments(S.stream_wav(spark, str(tmp_path / "in")), seconds=1.0), "wavs").orderBy("segment_index").collect()
    assert [(r.source_file, r.start_sec, r.end_sec, len(r.content)) for r in segments] == [("a.wav", float(i), i + 1.0, 16000) for i in range(4)]


def test_windows(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "events"))
    events = S.event_time(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events")), lateness="400 days")
    own = lambda d: {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in d.collect()}
    got = own(run(S.tumbling(events, ["event_type"]), "tumbled", "complete"))
    assert got == own(S.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"]))


def test_speech_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    probs = [0.9] * 5 + [0.1] * 6 + [0.8] * 3 + [0.1] * 4
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(probs)] + [("b", 0, 0.1)], "key string, frame long, prob double")
    df.write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "frames"))
    got = run(S.stream_speech(stream, "key"), "spoken").orderBy("start_frame").collect()
    assert [(r.key, r.start_frame, r.end_frame, round(r.confidence, 3)) for r in got] == [("a", 0, 4, 0.9), ("a", 11, 13, 0.8)]
