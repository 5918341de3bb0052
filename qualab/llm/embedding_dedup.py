"""Embedding near-dedup: a forest of random-projection trees with spill.

Vectors of one label (and dimension) are compared.  Equal vectors are one, with a count.  Each tree splits
its vectors again and again at the median along a random direction; vectors near the median go to both
sides (spill).  Two unit vectors of cosine ``least`` are at distance sqrt(2 - 2 least), and their
projections differ by that over sqrt(dimension) on average, so the spill is set in these units; many trees
make it all but sure that a close pair shares a leaf.  The trees are fit on a bounded sample of all
vectors; every vector goes through all trees.

Vectors are compared within their leaves; a leaf gives the links of a spanning forest of its close pairs,
not all of them.  Links join to components, and what is close to a vector lies in its component, so the
numbers of links are counted there.  Leaves and components of more than ``BLOCK`` vectors are compared as
pairs of blocks, each a group of its own; no group is larger than two blocks and no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .components import _forest, components

LEAST = 0.98
TREES = 6
SPILL = 0.75  #: on each side of a split, in mean projected distances of a pair at the limit
LEAF = 1024  #: vectors a leaf should have
SAMPLE = 1 << 16  #: vectors that the trees are fit on
BLOCK = 2048


@dataclass
class Tree:
    """A node's split: threshold along the direction of its depth; children of node k are 2k and 2k + 1."""

    thresholds: dict[int, float] = field(default_factory=dict)

    def leaves(self, projected: np.ndarray, spill: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for rows of projections, one column a depth."""
        nodes = [(1, np.arange(len(projected)))]
        while nodes:
            node, rows = nodes.pop()
            if node not in self.thresholds:
                yield node, rows
                continue
            value = projected[rows, node.bit_length() - 1] - self.thresholds[node]
            nodes += [(2 * node, rows[value <= spill]), (2 * node + 1, rows[value >= -spill])]


def _directions(tree: int, dimension: int, depth: int) -> np.ndarray:
    d = np.random.default_rng([tree, dimension]).normal(size=(depth, dimension))
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).T


def _spill(dimension: int, least: float) -> float:
    return SPILL * float(np.sqrt(2 - 2 * least) / np.sqrt(dimension))


def _depth(rows: float) -> int:
    return max(0, int(np.ceil(np.log2(max(rows, 1) / LEAF))))


def fit_tree(sample: np.ndarray, tree: int, rows: float, least: float) -> Tree:
    """``sample``: unit vectors of one label; ``rows``: how many vectors the label has in all."""
    out, depth = Tree(), _depth(rows)
    if not depth or len(sample) < 32:
        return out
    spill, d = _spill(sample.shape[1], least), sample @ _directions(tree, sample.shape[1], depth)
    nodes = [(1, np.arange(len(sample)))]
    while nodes:
        node, at = nodes.pop()
        level = node.bit_length() - 1
        if level >= depth or len(at) < 32 or len(at) * rows / len(sample) <= LEAF:
            continue
        value = d[at, level]
        middle = float(np.median(value))
        low, high = at[value <= middle + spill], at[value >= middle - spill]
        if max(len(low), len(high)) > 0.95 * len(at):
            continue  # this direction tells nothing here; the node stays a leaf, compared in blocks
        out.thresholds[node] = middle
        nodes += [(2 * node, low), (2 * node + 1, high)]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors (all of one dimension) in double precision."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with i, j: a group of n rows is cut into blocks by hash, and each pair of blocks is a group."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    one = rows.join(sizes, keys).withColumn("_b", F.pmod(F.xxhash64("rid"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return one.withColumn("_o", other).withColumn("i", F.least("_b", "_o")).withColumn("j", F.greatest("_b", "_o")).drop("_blocks", "_o")


def _close(part: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers that are close, a strip of the comparison at a time; between two blocks only across."""
    x, block = _matrix(part["embedding"].combine_chunks()), part["_b"].to_numpy()
    if block.min() != block.max():
        a, b = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    elif part["i"][0] != part["j"][0]:
        return  # one of the two blocks has no row
    else:
        a = b = np.arange(len(x))
    for at in range(0, len(a), 512):
        p, q = np.nonzero(x[a[at : at + 512]] @ x[b].T >= least)
        p, q = a[at + p], b[q]
        yield p[p != q], q[p != q]


def near_duplicates(vectors: DataFrame, least: float = LEAST, trees: int = TREES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows without a label, and null, zero or non-finite vectors, link with nothing; a row without vec_id
    takes part in counts but not in ids.  Repeated rows count as vectors of their own.
    """
    spark = vectors.sparkSession
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.expr(
        "coalesce(forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0), false)")
    rows = stored(vectors.select("vec_id", "label", "embedding", good.alias("_good")).withColumn(
        "_h", F.xxhash64("embedding")).withColumn("_g", F.hash("embedding")).withColumn("_d", F.size("embedding")), "vectors")
    copy = ["label", "_d", "_h", "_g"]
    reps = stored(rows.where("_good").groupBy(*copy).agg(
        F.min("vec_id").alias("rid"), F.count("*").alias("n"), F.first("embedding").alias("embedding")).where("rid is not null"), "vectors-distinct")
    sizes = {(r["label"], r["_d"]): r["n"] for r in reps.groupBy("label", "_d").agg(F.count("*").alias("n")).where(f"n > {LEAF}").collect()}
    total = sum(sizes.values())
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    sample = reps.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < share).select("label", "_d", "embedding").limit(2 * SAMPLE).toArrow()
    forest: dict[tuple, list[Tree]] = {}
    for key, n in sizes.items():  # labels of more than a leaf: total / LEAF of them at most
        own = sample.filter((pa.compute.equal(sample["label"], key[0])).to_pandas().to_numpy() & (sample["_d"].to_numpy() == key[1]))
        if own.num_rows:
            x = _matrix(own["embedding"].combine_chunks())
            forest[key] = [fit_tree(x, t, n, least) for t in range(trees)]
    held = spark.sparkContext.broadcast((forest, {k: _depth(n) for k, n in sizes.items()}))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, depths = held.value
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("_d").to_numpy()
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(labels, dims.tolist())):
                groups.setdefault(key, []).append(k)
            at, tree, leaf = [], [], []
            for key, own in groups.items():
                own = np.array(own)
                if key not in forest:  # a small label is one leaf, of one tree
                    at.append(own), tree.append(np.zeros(len(own), int)), leaf.append(np.ones(len(own), int))
                    continue
                x = _matrix(batch.column("embedding").take(pa.array(own)))
                for t, planted in enumerate(forest[key]):
                    projected = x @ _directions(t, key[1], depths[key]) if depths[key] else np.zeros((len(own), 0))
                    for node, some in planted.leaves(projected, _spill(key[1], least)):
                        at.append(own[some]), tree.append(np.full(len(some), t)), leaf.append(np.full(len(some), node))
            at = pa.array(np.concatenate(at)) if at else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("label", "_d", "rid", "embedding")]
                + [pa.array((np.concatenate(x) if x else np.zeros(0)).astype(np.int64)) for x in (tree, leaf)],
                names=["label", "_d", "rid", "embedding", "tree", "leaf"])

    source = reps.select("label", "_d", "rid", "embedding")
    leaves = source.mapInArrow(route, source.withColumn("tree", F.lit(0).cast("long")).withColumn("leaf", F.lit(0).cast("long")).schema)
    leaves = stored(leaves, "vectors-leaves")

    def link(part: pa.Table) -> pa.Table:
        rid = part["rid"].to_numpy()
        node, top = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, q in _close(part, least):
            a, b = _forest(rid[p], rid[q])
            node.append(a), top.append(b)
        return pa.table({"node": pa.array(np.concatenate(node)), "top": pa.array(np.concatenate(top))})

    keys = ["label", "_d", "tree", "leaf"]
    links = _blocked(leaves, keys).groupBy(*keys, "i", "j").applyInArrow(link, "node long, top long")
    group = stored(components(stored(links.distinct(), "vectors-links"), "vectors-groups").select(F.col("node").alias("rid"), "component"), "vectors-component")

    def count(part: pa.Table) -> pa.Table:
        rid, n = part["rid"].to_numpy(), part["n"].to_numpy()
        total = np.zeros(len(rid), np.int64)
        across = part["i"][0] != part["j"][0]
        for p, q in _close(part, least):
            total += np.bincount(p, n[q], len(rid)).astype(np.int64)
            if across:
                total += np.bincount(q, n[p], len(rid)).astype(np.int64)
        return pa.table({"rid": pa.array(rid), "linked": pa.array(total)})

    linked = _blocked(reps.join(group, "rid"), ["component"]).groupBy("component", "i", "j").applyInArrow(
        count, "rid long, linked long").groupBy("rid").agg(F.sum("linked").alias("linked"))
    result = reps.select(*copy, "rid", "n").join(group, "rid", "left").join(linked, "rid", "left").select(
        *(F.col(c).alias(f"_k{c}") for c in copy), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rid").alias("_component"))
    match = [rows[c] == result[f"_k{c}"] for c in copy]
    done = rows.join(result, match + [rows["_good"]], "left")
    component = F.coalesce("_component", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
