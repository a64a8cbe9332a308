"""Connected components of an edge table: alternating stars, every step a pair of joins; small graphs are folded in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import cut

MAX_ROUNDS = 60
#: Edges (16 bytes each) that one task folds at most; a larger graph takes rounds of joins.
FOLDED = 16_384


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the least node that each of them reaches."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        both = np.minimum(label[left], label[right])
        # The labels' labels move too, so that long paths halve.
        for end in (left, right, label[left], label[right]):
            np.minimum.at(least, end, both)
        least = least[least]
        if (least == label).all():
            return nodes, nodes[label]
        label = least


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    nodes, labels = least_labels(table.column("a").to_numpy(), table.column("b").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are tied to the least node it sees; small star: the smaller ones and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    tied = both.join(least, both["u"] == least["k"])
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node reachable, for each node of ``edges`` (a, b: long, not null).

    Self-loops and repeated edges don't matter; an empty edge table gives an empty result.  Raises RuntimeError when
    ``MAX_ROUNDS`` don't suffice (rounds grow with the logarithm of the longest path).
    """
    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if now.count() <= FOLDED:
        return now.coalesce(1).mapInArrow(_fold, "node long, component long")
    last = None
    for _ in range(MAX_ROUNDS):
        now = cut(_star(_star(now, large=True), large=False), "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == last:
            break
        last = (state.n, state.h)
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
