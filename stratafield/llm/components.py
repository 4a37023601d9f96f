"""Connected components of a table of links, by alternating star contraction.

Up to ``ONE_TASK`` links are joined in one task, whose memory that number bounds;
more of them are contracted in rounds, with the same result.

Large star: every node's larger neighbours point to its smallest neighbour.
Small star: a node and its smaller neighbours point to the smallest of them.
Repeated until every node has one smaller neighbour or only larger ones, the links
are stars around the smallest node of each component.  Each round is written to the shared folder; of the
rounds nothing is gathered in one task, and nothing on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import materialize

#: Links that one task joins: 16 bytes each, a few times that while it works.
ONE_TASK = 1 << 18


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.union(least.select("u", "m")).distinct()


def _open(links: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or one smaller and one larger."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("below")).union(links.select("b", F.lit(0)))
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return not seen.filter("below > 1 OR (below = 1 AND least = 0)").isEmpty()


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), ascending, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        if parts:
            node, root = roots_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for at in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], pa.int64()) for x in (node, root)], ["node", "root"])

    return links.repartition(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, root being the smallest
    reachable node; links (a, b) of longs, in any order, self-links allowed.
    ``links`` is read twice."""
    links = links.filter("a != b")
    if links.count() <= ONE_TASK:
        return _in_one_task(links.select("a", "b"))
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while _open(now):
        now = materialize(_small(_large(now)), "links")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select("b", "b").distinct())
