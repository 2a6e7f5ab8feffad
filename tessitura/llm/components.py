"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.blocks import checkpointed


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of the links a[i] - b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
    return nodes, nodes[label]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each node, to the smallest that it reaches: the same components."""
    nodes, low = smallest_reachable(a, b)
    keep = nodes != low
    return nodes[keep], low[keep]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) to (node, component): the smallest node that each node reaches.

    In each round every node points to its smallest neighbour if that is smaller, the
    pointers are followed by doubling until they all end at roots, and links between
    nodes of one root vanish; what is left is a smaller graph of roots.  Every root that still has
    links has swallowed a neighbour or is swallowed next, so a round halves them at least.  Rounds end at checkpoints.  Nodes with links to themselves only are
    not in the result.
    """
    e = checkpointed(links.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forests, "a long, b long"))
    maps: list[DataFrame] = []
    while not maps or not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up"))
        step, moved = checkpointed(step), True
        while moved:
            above = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = step.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), (F.col("top") < F.col("up")).alias("moved"))
            jumped = checkpointed(jumped)
            moved = not jumped.where("moved").isEmpty()
            step = jumped.drop("moved")
        maps.append(step)
        x, y = step.select(F.col("node").alias("a"), F.col("up").alias("x")), step.select(F.col("node").alias("b"), F.col("up").alias("y"))
        e = checkpointed(e.join(x, "a").join(y, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    found = maps[0]
    for step in maps[1:]:
        found = found.join(step.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return found.select("node", F.col("up").alias("component"))
