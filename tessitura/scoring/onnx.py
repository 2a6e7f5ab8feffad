"""Scoring a column of features, rows of one shape at a time."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.scoring.sessions import Described, Model, Session, describe

LONGER = "is_longer"


def shaped(data: np.ndarray, frames: int, dim: int, d: Described) -> tuple[np.ndarray, bool]:
    """One row's features as the model takes them, without the batch, and whether frames were cut off.

    A fixed number of frames is cut or padded with zeros to.
    """
    rank = len(d.input_dims)
    if rank not in (3, 4):
        return np.asarray(data, np.float32), False
    x = np.asarray(data, np.float32).reshape(frames, dim)
    expected = d.input_dims[-2]
    longer = expected > 0 and frames > expected
    if expected > 0 and frames != expected:
        y = np.zeros((expected, dim), np.float32)
        y[: min(frames, expected)] = x[:expected]
        x = y
    return (x[None] if rank == 4 else x), longer


def score_batch(session: Session, d: Described, rows: list[tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
    """Flat scores of rows (data, frames, dim).  Rows of one shape run together if the model lets them."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(rows)
    same: dict[tuple, list[int]] = defaultdict(list)
    inputs = [shaped(*r, d) for r in rows]
    for i, (x, longer) in enumerate(inputs):
        same[x.shape, longer].append(i)
    together = not d.input_dims or d.input_dims[0] < 0
    for (_, longer), members in same.items():
        step = 64 if together else 1
        for a in range(0, len(members), step):
            own = members[a : a + step]
            feeds = {d.input: np.stack([inputs[i][0] for i in own])}
            if LONGER in d.inputs:
                feeds[LONGER] = np.full((len(own), 1), longer)
            scores = session.run([d.output], feeds)[0]
            for i, s in zip(own, scores, strict=True):
                out[i] = np.asarray(s, np.float32).ravel()
    return out


def onnx_score(df: DataFrame, model: Model, features: str = "Features", scores: str = "Scores", input: str | None = None, output: str | None = None) -> DataFrame:
    """df with scores (array<float>) of its features (struct<data, frames, dim>).

    The column's metadata has hidden_dim and has_pooled_output, for those that pool.
    """
    d = describe(model.session(), input, output)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        session = shared.value.session()
        for batch in batches:
            rows = [(x, int(f), int(n)) for x, f, n in zip(batch["data"], batch["frames"], batch["dim"], strict=True)]
            yield pd.Series(score_batch(session, d, rows))

    column = score(F.struct(f"{features}.data", f"{features}.frames", f"{features}.dim"))
    return df.withColumn(scores, column.alias(scores, metadata={"hidden_dim": d.hidden_dim, "has_pooled_output": d.pooled}))
