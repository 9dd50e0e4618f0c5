"""Connected components by alternating large and small stars, without collecting anything to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import drop_table, materialize, tidy


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as a - b: each node that isn't the smallest of its component, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        for end in (u, v):
            np.minimum.at(root, end, low)
            np.minimum.at(root, before[end], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(root, before):
            break
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def _contract(batches: Iterator[pa.RecordBatch], most: int = 2 * 1_000_000) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, dtype=np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > most:
            a, b = forest(a, b)
            if len(a) > most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a = b = np.zeros(0, dtype=np.int64)
    if len(a):
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


#: Links, two numbers each, that one task resolves.
FEW = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b, longs. One row per linked node: node, component (the smallest node reachable).

    Each partition first reduces its links to a forest. Where FEW links are left, one task resolves them. Else a round takes
    two joins with partial minima; hot nodes are left to the skew handling of joins. The rounds needed grow with the
    logarithm of the number of nodes.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(tidy(_contract), "a long, b long").distinct(), "links")
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(tidy(_contract), "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("end")
        small = large.join(least, "a").select(ends, "m").select(F.col("end.x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = materialize(small, "links")
        drop_table(large)
        drop_table(edges)
        edges = new
