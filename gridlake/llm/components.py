"""Connected components of a table of edges, by local contraction and alternating large and small stars.

What contraction leaves is finished by one task where it is at most MOST_AT_ONCE edges: rounds of joins
over a few edges cost the driver more memory for plans, stages and threads than the edges take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import discard, small_batches, tidy, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and smallest node of its component, for nodes that aren't the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by a forest of the same components; batches keep memory bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            a, b = np.concatenate([a, np.asarray(batch.column(0))]), np.concatenate([b, np.asarray(batch.column(1))])
            fresh += batch.num_rows
            if fresh > 500_000:
                (a, b), fresh = forest(a, b), 0
        if len(a):
            a, b = forest(a, b)
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


#: Rows of one node that a join may gather; nodes with more are few enough to broadcast.
MOST_OF_NODE = 1000
MOST_HOT = 100_000
#: Edges, of 16 bytes, that one task finishes; more take rounds of stars.
MOST_AT_ONCE = 50_000


def _attached(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with m of a from least (a, m, degree). total rows in all.

    Nodes of many rows (at most 2 * total / bound of them, so at most MOST_HOT) are joined by broadcast: a
    star's rows stay where they are. The other nodes have few rows each.
    """
    bound = max(MOST_OF_NODE, 2 * total // MOST_HOT)
    many = least.where(F.col("degree") > bound).select("a", "m").toArrow()
    if not many.num_rows:
        return rows.join(least.select("a", "m"), "a")
    hot = F.broadcast(rows.sparkSession.createDataFrame(many, "a long, m long"))
    mild = least.where(F.col("degree") <= bound).select("a", "m")
    return rows.join(hot, "a").unionByName(rows.join(hot, "a", "left_anti").join(mild, "a"))


def components(edges: DataFrame, at_once: int = MOST_AT_ONCE) -> DataFrame:
    """(node, label) of the nodes that aren't the smallest of their component; label is the smallest.

    Edges are columns a and b, longs that aren't null; loops and repeated edges do no harm. Each round is
    written, so lost executors cost a round at most.
    """
    small_batches(edges.sparkSession)
    now = written(contract(edges.where("a <> b")), "edges")
    total = now.count()
    if total <= at_once:
        return contract(now.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("label"))
    seen = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("__b"), F.count(F.lit(1)).alias("degree")).select("a", F.least("a", "__b").alias("m"), "degree")
        large = _attached(both.where("b > a"), low, 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = up.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        small = _attached(up, least, 2 * total)
        stars = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, now = now, written(stars, "edges")
        discard(before)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        state, total = (found[0], found[1]), found[0]
        if state == seen or not found[0]:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
        seen = state
