"""Connected components of an edge table, by star contraction.

Each round contracts the edges of every partition to a forest (one task holds
one partition's nodes, nothing more), then takes one large-star and one
small-star step as joins, until every node has a single edge to the smallest
node of its component.  The number of rows never exceeds that of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelake.llm import work


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it is joined to) for all nodes of the edges but those smallest."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        a = np.concatenate((a, batch.column(0).to_numpy(zero_copy_only=False)))
        b = np.concatenate((b, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(a) > 2_000_000:
            a, b = forest(a, b)
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``edges`` but the smallest of each component, ``root`` being that smallest.

    Nulls, self-loops and repeated edges are left out.  Without edges the result has no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("node"), F.least(a, b).cast("long").alias("root")).where("node is not null and root is not null and node > root")
    saved = None
    while True:
        old, e = saved, work.save(e.mapInArrow(_contract, "node long, root long").distinct())
        saved = e
        if old is not None:
            work.drop(old)
        roots = e.groupBy("node").agg(F.min("root").alias("root"), F.count("*").alias("n"))
        chained = e.join(e.select(F.col("node").alias("root")).distinct(), "root", "left_semi")
        if roots.where("n > 1").isEmpty() and chained.isEmpty():
            return e
        both = e.union(e.select("root", "node"))
        low = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        large = both.where("root > node").join(low, "node").where("root > low").select(F.col("root").alias("node"), F.col("low").alias("root"))
        large = large.union(e.join(low, "node").where("node > low").select("node", F.col("low").alias("root"))).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(least, "node").select(F.explode(F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))).alias("e")).select("e.*")
        e = small.where("node > root").distinct()
