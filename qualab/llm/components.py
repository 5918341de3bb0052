"""Connected components of a table of links, as Spark jobs (large-star / small-star)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its part) over the links of one batch."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    top = np.array([root(x) for x in range(len(nodes))], np.int64)
    other = top != np.arange(len(nodes))
    return nodes[other], nodes[top[other]]


def _by_batch(links: DataFrame) -> DataFrame:
    """The links of each Arrow batch as a forest: as connected, and no more links than nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, top = _forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(top)], names=["node", "top"])

    return links.mapInArrow(run, "node long, top long")


def components(links: DataFrame, name: str) -> DataFrame:
    """node, component (the least node reachable) for every node of ``links`` (two long columns).

    Each round hangs all neighbours of a node below the least of them, once for the greater ones and once
    for the smaller; the least neighbour is an aggregate (combined before the shuffle) joined back, so a
    node with very many links is no hot group.  Rounds end when the links no longer change.
    """
    a, b = links.columns
    links = stored(_by_batch(links.select(a, b).where(F.col(a) != F.col(b))).distinct(), name)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("node", "top").cast("decimal(38,0)"))).first())

    before = state(links)
    while before[0]:
        both = links.select(F.col("node").alias("u"), F.col("top").alias("v")).union(links.select("top", "node"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        large = (both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("node"), F.col("m").alias("top"))
                 .where("node != top").distinct())
        low = large.groupBy("node").agg(F.min("top").alias("m")).select(F.col("node").alias("_u"), "m")
        small = large.join(low, F.col("node") == F.col("_u")).select(F.col("top").alias("node"), F.col("m").alias("top"))
        links = stored(small.union(low.select("_u", "m")).where("node != top").distinct(), name)
        after = state(links)
        if after == before:
            break
        before = after
    tops = links.select(F.col("top").alias("node")).distinct()
    return links.select("node", F.col("top").alias("component")).union(tops.select("node", F.col("node").alias("component")))
