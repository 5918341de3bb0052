"""Merkle manifest of a table: a content-addressed DAG of digests, inclusion proofs by descent, verification.

Every row is a leaf: the hash of its named columns, each as length and value.  Leaves stand in the order of
their key within a tree (here: per language); while a level has several nodes, every run of ``FANOUT``
becomes its parent, the hash of the children's digests.  The subroots, in the order of their trees, are
grouped likewise up to the root.  Each level is stored as records ``digest -> children``.

A proof request descends from the root: at every record the rank's digit picks the child, the other children
are collected as one segment of the path, and the segments, found from the root down, are reversed into the
order of verification.  Requests that share a prefix share its records and its path, so the rows on the way
are the nodes of a level, not the leaves; records meet them by digest.  A record is kept per digest and
residue of its place, so a digest that many places share (repeated rows) is no hot key.

Ranks are distributed: rows are range-partitioned on (tree, key, digest, row number), which is unique, and a
small table of counts gives each run its offset.

Null values count as ``-``; a null tree (language) comes first, a null key comes before the others.  Repeated
rows are leaves of their own, in any order (their digests are equal).  An empty table gives no rows.  Only the
named columns are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .sharding import CRC_TABLE, crc_sql

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RUN_ROWS = 4_000_000  #: rows of a range partition on large tables
RESIDUES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: Sequence[Column]) -> Column:
    """Hash of the values: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``n`` (rows) within ``tree``, in the order of ``order``, which must be unique."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RUN_ROWS)
    by = ["tree", *order]
    placed = stored(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(
        "at", F.monotonically_increasing_id()), name).withColumn("run", F.shiftright("at", 33))
    of_tree = Window.partitionBy("tree")
    runs = placed.groupBy("tree", "run").agg(F.min("at").alias("first"), F.count("*").alias("held")).select(
        "tree", "run", "first", F.sum("held").over(of_tree).alias("n"),
        (F.sum("held").over(of_tree.orderBy("run")) - F.col("held")).alias("before"))
    return placed.join(runs, ["tree", "run"]).withColumn(
        "rank", F.col("before") + F.col("at") - F.col("first")).drop("run", "at", "first", "before")


@dataclass
class Forest:
    """Trees over ranked nodes: ``nodes`` (tree, rank, n, digest, info) and the records of each level above them
    (tree, rank, n, digest, children: digest and info), lowest first."""

    nodes: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """tree, digest: the node that remains of each tree."""
        rows = [d.where("n = 1").select("tree", "digest") for d in (self.nodes, *self.levels)]
        out = rows[0]
        for d in rows[1:]:
            out = out.union(d)
        return out


def grow(nodes: DataFrame, name: str) -> Forest:
    """All levels above ``nodes``; a level is as large as an eighth of the one below it."""
    level, levels = nodes, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        info = F.col("info") if not levels else F.lit(None).cast(nodes.schema["info"].dataType)
        runs = level.where("n > 1").withColumn("info", info).groupBy(
            "tree", F.expr(f"rank div {FANOUT}").alias("rank"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), "digest", "info"))).alias("children"))
        level = stored(runs.select(
            "tree", "rank", "n", F.sha2(F.array_join(F.col("children.digest"), ""), 256).alias("digest"),
            F.transform("children", lambda x: F.struct(x["digest"].alias("digest"), x["info"].alias("info"))).alias("children")), name)
        levels.append(level)
        most = -(-most // FANOUT)
    return Forest(nodes, levels)


SEGMENTS = "array<struct<left:string,right:string>>"


def descend(forest: Forest, starts: DataFrame, wanted: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """Paths from the roots to the nodes: tree, rank, digest, info, head and path (segments, root first).

    ``starts`` has tree, head (anything that goes along) and path of each tree's root.  ``wanted(k)`` gives the
    (tree, rank) of the nodes at level k above the nodes that requests pass; all nodes without it.
    """
    place = F.pmod(F.col("rank"), F.lit(RESIDUES)).alias("residue")
    frontier = None
    for k in range(len(forest.levels), -1, -1):
        level = forest.levels[k - 1] if k else forest.nodes
        if frontier is not None:  # records by digest: each child, and the others as a segment of its path
            records = forest.levels[k].groupBy("digest", place).agg(F.first("children").alias("children"))
            met = frontier.withColumn("residue", place).join(records, ["digest", "residue"])
            opened = met.select("tree", "rank", "head", "path", "children", F.posexplode("children").alias("digit", "child"))
            frontier = opened.select(
                "tree", (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), "child.digest", "child.info", "head",
                F.concat("path", F.array(F.struct(
                    F.expr("array_join(slice(children, 1, digit).digest, '')").alias("left"),
                    F.expr(f"array_join(slice(children, digit + 2, {FANOUT}).digest, '')").alias("right")))).alias("path"))
        info = F.col("info") if not k else F.lit(None).cast(forest.nodes.schema["info"].dataType).alias("info")
        roots = level.where("n = 1").join(starts, "tree").select("tree", "rank", "digest", info, "head", "path")
        frontier = roots if frontier is None else frontier.union(roots)
        if wanted is not None:
            frontier = frontier.join(wanted(k), ["tree", "rank"], "left_semi")
    return frontier


@dataclass
class Manifest:
    """The trees of a table, and the tree over their roots."""

    trees: Forest
    top: Forest

    def paths(self, requests: DataFrame | None = None) -> DataFrame:
        """tree, rank, digest, info, head (subroot, root) and path (segments from the root down) of all leaves, or of
        those that ``requests`` (tree, rank) names."""
        start = self.top.roots().select("tree", F.struct(F.col("digest").alias("root")).alias("head"),
                                        F.expr(f"cast(array() as {SEGMENTS})").alias("path"))
        subroots = descend(self.top, start).select(
            F.col("info.tree").alias("tree"), F.struct(F.col("digest").alias("subroot"), "head.root").alias("head"), "path")
        wanted = None
        if requests is not None:
            wanted = lambda k: requests.select("tree", F.expr(f"rank div {FANOUT ** k}L").alias("rank")).distinct()
        return descend(self.trees, subroots, wanted)


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: tree (string, not null), key, digest, and info (a struct that goes along)."""
    rows = stored(leaves.withColumn("id", F.monotonically_increasing_id()), "merkle-leaves")
    trees = grow(ranked(rows, ["key", "digest", "id"], "merkle-ordered").select("tree", "rank", "n", "digest", "info"), "merkle-level")
    subroots = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.struct("tree").alias("info"))
    return Manifest(trees, grow(ranked(stored(subroots, "merkle-subroots"), ["name"], "merkle-top"), "merkle-top-level"))


def proof(path: Column) -> Column:
    """The siblings from the leaf's level up to the root, left to right, as one text."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from ``leaf`` and the siblings of ``path``."""
    return F.aggregate(F.reverse(path), leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def verify(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs``, and every leaf's proof held against its row after tampering: where 3 divides the crc32 of
    the id, the text's letters A-Z are lower-cased (null texts and null ids stay)."""
    values = [F.col(c) for c in COLUMNS]
    changed = [F.translate(c, UPPER, LOWER) if n == "text" else c for n, c in zip(COLUMNS, values)]
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),  # '-' < '=': null first
        F.col("doc_id").alias("key"), leaf_digest(values).alias("digest"),
        F.struct(F.col("doc_id"), F.when(touched & F.col("text").isNotNull(), leaf_digest(changed)).alias("tampered")).alias("info"))
    paths = manifest(leaves).paths()
    out = paths.select(
        "info.doc_id", F.col("digest").alias("leaf"), "head.subroot", "head.root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("info.tampered", "digest")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``documents``."""
    return verify(table(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
             for c in (*COLUMNS[:-1], text)]
    return f"sha256({' || '.join(parts)})"


def _level_sql(name: str, k: int) -> str:
    """Groups runs of eight; a tree of one node goes up as it is."""
    up = "CASE WHEN n > 1 THEN rank // 8 ELSE rank END"
    return f"""{name}{k} AS (SELECT tree, {up} AS rank, (n + 7) // 8 AS n, n > 1 AS grouped, list(digest ORDER BY rank) AS kids,
    CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY rank)) ELSE any_value(digest) END AS digest
    FROM {name}{k - 1} GROUP BY tree, n, {up})"""


def _step_sql(name: str, source: str, records: str, kept: str, tree: str, at: str, node: str, path: str, join: str = "") -> str:
    """One level up for every leaf: ``at`` is its place below, ``node`` the digest folded so far, ``path`` the siblings."""
    place = f"CASE WHEN l.grouped THEN {at} // 8 ELSE {at} END"
    left, right = f"array_to_string(l.kids[1:({at} % 8)], '')", f"array_to_string(l.kids[({at} % 8) + 2:], '')"
    return f"""{name} AS (SELECT {kept}, {place} AS at,
    CASE WHEN l.grouped THEN sha256({left} || {node} || {right}) ELSE {node} END AS node,
    CASE WHEN l.grouped THEN {path} || {left} || {right} ELSE {path} END AS path
    FROM {source} x {join} JOIN {records} l ON l.tree = {tree} AND l.rank = {place})"""


def oracle(levels: int = 7, top: int = 3) -> str:
    """DuckDB SQL for up to 8^levels documents in up to 8^top languages: the levels and the fold written out."""
    parts = [CRC_TABLE, f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
    FROM documents, crc_table)""", """n0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    count(*) OVER (PARTITION BY tree) AS n, leaf AS digest, doc_id, tampered FROM leaves)"""]
    parts += [_level_sql("n", k) for k in range(1, levels + 1)]
    parts.append(f"m0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n, digest, tree AS name FROM n{levels})")
    parts += [_level_sql("m", k) for k in range(1, top + 1)]
    kept = "x.doc_id, x.tree, x.digest"
    parts.append(_step_sql("p1", "n0", "n1", kept, "x.tree", "x.rank", "coalesce(x.tampered, x.digest)", "''"))
    parts += [_step_sql(f"p{k}", f"p{k - 1}", f"n{k}", kept, "x.tree", "x.at", "x.node", "x.path") for k in range(2, levels + 1)]
    parts.append(_step_sql("q1", f"p{levels}", "m1", kept + ", m0.digest AS subroot", "''", "m0.rank", "x.node", "x.path", "JOIN m0 ON m0.name = x.tree"))
    parts += [_step_sql(f"q{k}", f"q{k - 1}", f"m{k}", kept + ", x.subroot", "''", "x.at", "x.node", "x.path") for k in range(2, top + 1)]
    return "WITH " + ", ".join(parts) + f"""
SELECT x.doc_id, x.digest AS leaf, x.subroot, m.digest AS root, sha256(x.path) AS proof_sha256, x.node AS folded_root,
    x.node = m.digest AS verified FROM q{top} x, m{top} m"""
