"""Connected components of a large graph, with joins and aggregates only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionloom.llm.common import discard, materialize


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n numbered nodes and links a-b, the least node of each one's component."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        differ = low != high
        if not differ.any():
            break
        np.minimum.at(label, high[differ], low[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        a, b = a[differ], b[differ]
    return label


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root being the component's least node.

    Alternates large-star and small-star steps: each node's neighbours, first the
    larger and then the smaller ones, are linked to its least neighbour. Stars are
    aggregates and joins on the node, so a hub is pre-aggregated and its join can
    be split. Each step is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = materialize(small, "edges")
        # a link's hash may be negative: their sum is taken as a decimal, so that it can't overflow
        row = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now, before, mark = after, mark, tuple(row)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
