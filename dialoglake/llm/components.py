"""Connected components: edges joined task by task, then rounds of large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import settle

#: Edges that one task joins: tasks are as many as they need, at every size.
EDGES = 2**19


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node tells its larger (or smaller) neighbours of the least node it sees."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger_only:
        both = both.where("b < a")
    # Written, so that both sides of the join are plain shuffles and Spark can split a hub's edges.
    least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    met = both.join(least, "a")
    told = met.where("b > a" if larger_only else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        told = told.unionByName(least.select("a", F.col("m").alias("b")))
    return told.where("a <> b").distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges, of bounded number -> each node with the least node that they lead to."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return
    ends = [np.concatenate(x) for x in zip(*held, strict=True)]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(ends[0])], at[len(ends[0]) :]
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (further := least[least] != least).any():
            least[further] = least[least[further]]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> node, root: the least node of its component. Nodes without an edge don't appear.

    Tasks of ``EDGES`` edges each first join what they hold, which leaves short paths; what several tasks hold apart meets in
    rounds over all edges, each written to the shared folder; rounds grow with the logarithm of the longest path left.
    """
    apart = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    dealt = max(1, -(-apart.count() // EDGES))
    now = settle(apart.repartition(dealt).mapInArrow(_joined, "a long, b long"))
    mark = None
    while dealt > 1:
        now = settle(_star(_star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
