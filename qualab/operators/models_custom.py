"""Models Spark ML lacks, built from Spark jobs: exact k-NN (M6, M17), AdaBoost SAMME (M8) and R2.

They follow the Spark ML shape (``fit(df) -> model``, ``model.transform(df)``,
``model.write().overwrite().save(path)``, ``Cls.load(path)``) and read ``features`` (vector),
``label`` and ``row_key`` columns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualab.functions.arrow import matrix
from qualab.session import ensure_checkpoint_dir


class _Writer:
    def __init__(self, save_fn):
        self._save = save_fn
        self._overwrite = False

    def overwrite(self):
        self._overwrite = True
        return self

    def save(self, path: str):
        self._save(path, self._overwrite)


def _write_json(spark: SparkSession, path: str, obj: dict, overwrite: bool) -> None:
    spark.createDataFrame([(json.dumps(obj),)], "meta string").coalesce(1).write \
         .mode("overwrite" if overwrite else "errorifexists").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


# =========================================================================== k-NN
MAX_PIVOTS = 1024
ROUTED = 256             # queries whose cells are looked up and listed at a time


def _squared(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound of each row's rounding error."""
    xn, qn = (x * x).sum(axis=1), (q * q).sum(axis=1)
    return qn[:, None] - 2.0 * q @ x.T + xn[None, :], (1e-12 * (qn + xn.max()) + 1e-300)[:, None]


def _nearest(q: np.ndarray, x: np.ndarray, order: np.ndarray, k: int, at_most: np.ndarray | None = None):
    """(query, row, distance) of each query's k nearest rows of ``x`` by distance, then by ``order``;
    only those within ``at_most`` where it is given."""
    near, slack = _squared(q, x)
    limit = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] + 2 * slack[:, 0]
    if at_most is not None:
        limit = np.minimum(limit, at_most ** 2 * (1 + 1e-12) + 2 * slack[:, 0])
    # every row that rounding may have put on the wrong side of the k-th is measured by differences
    i, j = np.nonzero(near <= limit[:, None])
    step = max(1, (1 << 22) // q.shape[1]) if q.shape[1] else len(i) or 1
    d = np.concatenate([np.sqrt(((x[j[a : a + step]] - q[i[a : a + step]]) ** 2).sum(axis=1)) for a in range(0, len(i), step)] or [np.zeros(0)])
    best = np.lexsort((order[j], d, i))
    i, j, d = i[best], j[best], d[best]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]


class KNeighbors:
    """Exact k nearest neighbours (Euclidean; equal distances by row key).  Classification votes
    (ties: smallest class), regression averages.  The training set is the model.

    ``fit`` takes up to ``MAX_PIVOTS`` training vectors (about the root of their number, those of the
    least hash) as pivots and measures the cells around them: rows, least and greatest distance."""

    def __init__(self, k: int = 5, problem_type: str = "clasificacion", block_rows: int = 4096, max_classes: int = 1000):
        self.k, self.problem_type, self.block_rows, self.max_classes = k, problem_type, block_rows, max_classes

    def fit(self, train: DataFrame) -> "KNeighborsModel":
        rows = train.select("row_key", "features", "label")
        x = rows.select(vector_to_array("features").alias("x"))
        count = rows.count()
        classes = None
        if self.problem_type == "clasificacion":
            classes = [r[0] for r in rows.select(F.col("label").cast("double")).distinct().orderBy("label").limit(self.max_classes + 1).collect()]
            if len(classes) > self.max_classes:
                raise ValueError(f"more than max_classes={self.max_classes} classes")
        pivots = min(MAX_PIVOTS, max(1, round(count ** 0.5)))
        chosen = x.distinct().orderBy(F.xxhash64("x"), "x").limit(pivots).toArrow()["x"]
        model = KNeighborsModel(rows, self.k, self.problem_type, self.block_rows,
                                matrix(chosen) if len(chosen) else np.zeros((0, 0)), classes=classes)
        return model.measure()


class KNeighborsModel:
    """Scoring sends each query first to the cell of its nearest pivot, whose k best give a radius,
    then to those cells alone that can hold a row within it: by the triangle inequality with the
    cell's least and greatest distance, and by the plane halfway between the two pivots.  A training
    row is in one cell.  Large cells are cut into blocks of ``block_rows`` rows, and many queries of
    a cell into blocks of as many, so that no group is larger than two blocks and no training x test
    row is made; nothing but the pivots passes through the driver."""

    def __init__(self, train: DataFrame, k: int, problem_type: str, block_rows: int, pivots: np.ndarray,
                 cells: np.ndarray | None = None, classes: list[float] | None = None):
        self.train, self.k, self.problem_type, self.block_rows = train, k, problem_type, block_rows
        self.classes = classes                       # of a classifier, in order
        self.pivots, self.cells = pivots, cells      # cells: rows, least, greatest distance of each pivot

    # ---------------------------------------------------------------- cells
    def _with_cell(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with the nearest pivot (``cell``) of the array column and the distance ``r`` to it."""
        held = rows.sparkSession.sparkContext.broadcast(self.pivots)
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, order = held.value, np.arange(len(held.value))
            for batch in batches:
                x = matrix(batch.column(column))
                found = [_nearest(x[a : a + 1024], pivots, order, 1) for a in range(0, len(x), 1024)]
                cell = np.concatenate([j for _, j, _ in found] or [np.zeros(0, int)]).astype(np.int32)
                r = np.concatenate([d for *_, d in found] or [np.zeros(0)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], names=[*names, "cell", "r"])

        return rows.mapInArrow(run, rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("r")).schema)

    def _train_cells(self) -> DataFrame:
        return self._with_cell(self.train.select(
            "row_key", vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")), "x")

    def measure(self) -> "KNeighborsModel":
        self.cells = np.zeros((len(self.pivots), 3))
        if len(self.pivots):
            rows = self._train_cells().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
            for r in rows.collect():                 # one row per pivot
                self.cells[r["cell"]] = r["n"], r["lo"], r["hi"]
        return self

    def _queries(self, df: DataFrame) -> DataFrame:
        """Distinct test rows: 128 hashed bits of key and features (so rows that share a key keep their own
        neighbours), and the features."""
        q = df.select(*self._query_id(df), vector_to_array("features").alias("qx"))
        return q.dropDuplicates(["q1", "q2"])

    @staticmethod
    def _query_id(df: DataFrame) -> list:
        x = vector_to_array(df["features"])
        return [F.xxhash64(df["row_key"], x).alias("q1"), F.xxhash64(F.lit(1), df["row_key"], x).alias("q2")]

    # ---------------------------------------------------------------- search
    def _search(self, sent: DataFrame) -> DataFrame:
        """The k best within ``radius`` of every block of the cells that the queries are sent to:
        (q1, q2, block, dist, nb_key, nb_label)."""
        k, width = self.k, self.block_rows
        blocks = [max(1, math.ceil(n / width)) for n in self.cells[:, 0]]
        asked = {r["cell"]: math.ceil(r["n"] / width) for r in sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = F.array(*[F.lit(asked.get(c, 0)) for c in range(len(blocks))])     # blocks of queries of each cell
        cut = F.array(*[F.lit(b) for b in blocks])
        of_cell = lambda a: F.get(a, F.col("cell"))
        left = sent.withColumn("part", F.pmod(F.xxhash64("q1", "q2"), of_cell(parts)).cast("int")) \
                   .withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(cut) - 1)))
        right = self._train_cells().where(of_cell(parts) > 0) \
                    .withColumn("block", F.pmod(F.xxhash64("row_key", "x"), of_cell(cut)).cast("int")) \
                    .withColumn("part", F.explode(F.sequence(F.lit(0), of_cell(parts) - 1)))

        def search(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
            none = pa.array([], pa.int64())
            if not queries.num_rows or not rows.num_rows:
                return pa.table({"q1": none, "q2": none, "block": none.cast(pa.int32()), "dist": none.cast(pa.float64()),
                                 "nb_key": none.cast(pa.string()), "nb_label": none.cast(pa.float64())})
            x, q = matrix(rows["x"]), matrix(queries["qx"])
            order = np.argsort(np.argsort(np.array(rows["row_key"].to_pylist(), dtype=object), kind="stable"), kind="stable")
            radius = queries["radius"].to_numpy()
            found = [(i + a, j, d) for a in range(0, len(q), 128)
                     for i, j, d in (_nearest(q[a : a + 128], x, order, k, radius[a : a + 128]),)]
            i, j, d = (np.concatenate(c) for c in zip(*found))
            return pa.table({"q1": queries["q1"].take(i), "q2": queries["q2"].take(i),
                             "block": pa.array(np.full(len(i), key[2].as_py(), np.int32)), "dist": d,
                             "nb_key": rows["row_key"].take(j), "nb_label": rows["y"].take(j)})

        return left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(
            search, "q1 long, q2 long, block int, dist double, nb_key string, nb_label double")

    def _best(self, found: DataFrame) -> DataFrame:
        """(q1, q2, nb): the k best of all blocks; of groups of blocks first where a cell has many."""
        top = lambda c: F.slice(F.array_sort(c), 1, self.k)
        one = F.struct("dist", "nb_key", "nb_label")
        if self.cells[:, 0].max() > 256 * self.block_rows:
            part = found.groupBy("q1", "q2", F.pmod("block", F.lit(256))).agg(top(F.collect_list(one)).alias("nb"))
            return part.groupBy("q1", "q2").agg(top(F.flatten(F.collect_list("nb"))).alias("nb"))
        return found.groupBy("q1", "q2").agg(top(F.collect_list(one)).alias("nb"))

    def routes(self, near: DataFrame) -> DataFrame:
        """(q1, q2, qx, radius, cell): the cells beyond its own that each query (with ``cell`` and the ``radius``
        its own cell gave, or NULL) has to visit."""
        held = near.sparkSession.sparkContext.broadcast((self.pivots, self.cells, self.k))
        names = ["q1", "q2", "qx"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, cells, k = held.value
            n, lo, hi = cells.T
            between = np.sqrt(np.maximum(_squared(pivots, pivots)[0], 0))
            few = (b.slice(a, ROUTED) for b in batches for a in range(0, b.num_rows, ROUTED))  # each may go to every cell
            for batch in few:
                q, home = matrix(batch.column("qx")), batch.column("cell").to_numpy()
                d2, slack = _squared(q, pivots)
                far, close = np.sqrt(np.maximum(d2 + slack, 0)), np.sqrt(np.maximum(d2 - slack, 0))
                # without k rows at home: cells by their farthest row, until they hold k rows
                reach = np.sort(far + hi, axis=1)
                held_rows = np.cumsum(n[np.argsort(far + hi, axis=1)], axis=1)
                enough = np.minimum((held_rows < k).sum(axis=1), len(n) - 1)
                radius = np.minimum(batch.column("radius").fill_null(np.inf).to_numpy(), reach[np.arange(len(q)), enough])
                radius[held_rows[:, -1] < k] = np.inf
                own = d2[np.arange(len(q)), home][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d2 - own - 2 * slack) / (2 * between[home])
                plane[~np.isfinite(plane)] = -np.inf
                least = np.maximum(np.maximum(close - hi, lo - far), plane)
                visit = (least <= (radius * (1 + 1e-9))[:, None]) & (n > 0)
                visit[np.arange(len(q)), home] = False
                i, j = np.nonzero(visit)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(i)) for c in names), pa.array(radius[i]),
                                                  pa.array(j.astype(np.int32))], names=[*names, "radius", "cell"])

        return near.mapInArrow(run, "q1 long, q2 long, qx array<double>, radius double, cell int")

    def nearest(self, df: DataFrame) -> DataFrame:
        """(q1, q2, nb): the k nearest training rows (dist, nb_key, nb_label) of every distinct test row."""
        ensure_checkpoint_dir(df.sparkSession)
        queries = self._with_cell(self._queries(df), "qx").drop("r")
        home = self._search(queries.withColumn("radius", F.lit(float("inf")))).checkpoint()  # ends the lineage: read twice
        kth = self._best(home).select(F.col("q1").alias("_q1"), F.col("q2").alias("_q2"),
                                      F.get("nb", F.lit(self.k - 1))["dist"].alias("radius"))
        near = queries.join(kth, (F.col("q1") == F.col("_q1")) & (F.col("q2") == F.col("_q2")), "left").drop("_q1", "_q2")
        beyond = self._search(self.routes(near).checkpoint())
        return self._best(home.unionByName(beyond))

    def transform(self, df: DataFrame) -> DataFrame:
        if not len(self.pivots):
            nothing = df.withColumn("prediction", F.lit(None).cast("double"))
            return nothing if self.problem_type != "clasificacion" else nothing.withColumn(
                "probability", array_to_vector(F.array(F.lit(0.0), F.lit(0.0))))
        labels = F.transform("nb", lambda s: s["nb_label"])
        top = self.nearest(df).select("q1", "q2", labels.alias("_l"))
        if self.problem_type == "clasificacion":
            # most votes, ties to the smallest class
            seen = F.array_sort(F.array_distinct("_l"))
            votes = F.transform(seen, lambda c: F.struct((-F.size(F.filter("_l", lambda x: x == c))).alias("v"), c.alias("c")))
            share = F.transform(F.array(*[F.lit(c) for c in self.classes]), lambda c: F.size(F.filter("_l", lambda x: x == c)) / F.size("_l"))
            pred = top.select("q1", "q2", F.array_min(votes)["c"].alias("prediction"), array_to_vector(share).alias("probability"))
        else:
            pred = top.select("q1", "q2", (F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / F.size("_l")).alias("prediction"))
        q1, q2 = self._query_id(df)
        return df.withColumn("_q1", q1).withColumn("_q2", q2).join(
            pred, (F.col("_q1") == F.col("q1")) & (F.col("_q2") == F.col("q2")), "left").drop("_q1", "_q2", "q1", "q2")

    def write(self):
        def save(path, overwrite):
            self.train.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/train")
            _write_json(self.train.sparkSession, f"{path}/meta",
                        {"k": self.k, "problem_type": self.problem_type, "block_rows": self.block_rows,
                         "pivots": self.pivots.tolist(), "cells": self.cells.tolist(), "classes": self.classes}, overwrite)
        return _Writer(save)

    @classmethod
    def load(cls, path: str) -> "KNeighborsModel":
        spark = SparkSession.getActiveSession()
        meta = _read_json(spark, f"{path}/meta")
        return cls(spark.read.parquet(f"{path}/train"), meta["k"], meta["problem_type"], meta["block_rows"],
                   np.array(meta["pivots"], dtype=float), np.array(meta["cells"], dtype=float), meta["classes"])


# =========================================================================== AdaBoost
def _next_round(old: DataFrame, new: DataFrame, cut: bool) -> DataFrame:
    """``new`` computed once, from the persisted ``old``, which is then released; ``cut`` ends the lineage."""
    new = new.persist(StorageLevel.MEMORY_AND_DISK)
    if cut:
        ensure_checkpoint_dir(new.sparkSession)
        kept = new.checkpoint(eager=True)
        new.unpersist()
        new = kept
    else:
        new.count()
    old.unpersist()
    return new


class AdaBoostSamme:
    """M8: SAMME boosting of depth-1 trees fitted with row weights (``weightCol``).  The weight
    update is a projection; its normaliser follows from the same aggregate that gives the
    error.  Each round's weights are persisted until the next round has read them; lineage is
    cut with a reliable checkpoint every few rounds.  ``max_classes`` bounds the class list that
    every model row carries; more raise an error."""

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, seed: int = 42, checkpoint_every: int = 10,
                 max_classes: int = 1000):
        self.n, self.lr, self.seed, self.every = n_estimators, learning_rate, seed, checkpoint_every
        self.max_classes = max_classes

    def fit(self, df: DataFrame) -> "AdaBoostSammeModel":
        classes = [r[0] for r in df.select("label").distinct().orderBy("label").limit(self.max_classes + 1).collect()]
        if len(classes) > self.max_classes:
            raise ValueError(f"more than max_classes={self.max_classes} classes")
        K = len(classes)
        n = df.count()
        data = df.select("features", "label", F.lit(1.0 / n).alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        stumps, alphas = [], []
        for m in range(self.n):
            stump = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=self.seed).fit(data)
            scored = stump.transform(data).select("features", "label", "w",
                                                  (F.col("prediction") != F.col("label")).cast("double").alias("miss"))
            agg = scored.agg(F.sum("w").alias("W"), F.sum(F.col("w") * F.col("miss")).alias("E")).first()
            err = agg["E"] / agg["W"]
            if err <= 0:
                stumps.append(stump)
                alphas.append(1.0)
                break
            if err >= 1.0 - 1.0 / K:
                if not stumps:
                    stumps.append(stump)
                    alphas.append(1.0)
                break
            alpha = self.lr * (math.log((1 - err) / err) + math.log(K - 1))
            stumps.append(stump)
            alphas.append(alpha)
            new_total = agg["W"] * ((1 - err) + err * math.exp(alpha))
            data = _next_round(data, scored.select(
                "features", "label", (F.col("w") * F.exp(F.lit(alpha) * F.col("miss")) / F.lit(new_total)).alias("w")),
                (m + 1) % self.every == 0)
        data.unpersist()
        return AdaBoostSammeModel(stumps, alphas, classes)


class AdaBoostSammeModel:
    def __init__(self, stumps, alphas, classes):
        self.stumps, self.alphas, self.classes = stumps, alphas, [float(c) for c in classes]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        cols = []
        for i, s in enumerate(self.stumps):
            s = s.copy()
            s.setPredictionCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}")
            out = s.transform(out).drop(f"_r{i}", f"_q{i}")
            cols.append(f"_p{i}")
        total = float(sum(self.alphas))
        scores = [sum((F.col(c) == F.lit(k)).cast("double") * F.lit(a) for c, a in zip(cols, self.alphas))
                  for k in self.classes]
        arr = F.array(*scores)
        best = F.array_max(arr)
        # first class reaching the best score (ties → smallest class)
        pred = F.coalesce(*[F.when(sc == best, F.lit(k)) for sc, k in zip(scores, self.classes)])
        prob = array_to_vector(F.transform(arr, lambda x: x / F.lit(total)))
        return out.withColumn("prediction", pred).withColumn("probability", prob).drop(*cols)

    def write(self):
        def save(path, overwrite):
            for i, s in enumerate(self.stumps):
                (s.write().overwrite() if overwrite else s.write()).save(f"{path}/stump_{i}")
            _write_json(SparkSession.getActiveSession(), f"{path}/meta",
                        {"alphas": self.alphas, "classes": self.classes}, overwrite)
        return _Writer(save)

    @classmethod
    def load(cls, path: str) -> "AdaBoostSammeModel":
        spark = SparkSession.getActiveSession()
        meta = _read_json(spark, f"{path}/meta")
        stumps = [DecisionTreeClassificationModel.load(f"{path}/stump_{i}") for i in range(len(meta["alphas"]))]
        return cls(stumps, meta["alphas"], meta["classes"])


def poisson_draws(uniform: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The Poisson count of each uniform number in [0, 1) at its rate, by its distribution function; a rate above 500
    is taken as 500 units and a sure rest."""
    sure = np.floor(np.maximum(rate - 500.0, 0.0))
    rate = rate - sure
    count, term = np.zeros(len(rate), np.int64), np.exp(-rate)
    total = term.copy()
    while (more := uniform >= total).any() and count.max(initial=0) < 2000:
        count[more] += 1
        term = np.where(more, term * rate / np.maximum(count, 1), term)
        total = np.where(more, total + term, total)
    return count + sure.astype(np.int64)


class AdaBoostR2:
    """AdaBoost.R2 (linear loss) with depth-3 regression trees, each grown on rows drawn by weight: row i is taken
    Poisson(n·w_i) times, from a hash of its key and the round, so draws are the same on any partitioning.  Errors and
    weights are those of all rows.  The prediction is the weighted median of the trees, per row with array functions."""

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, seed: int = 42, checkpoint_every: int = 10):
        self.n, self.lr, self.seed, self.every = n_estimators, learning_rate, seed, checkpoint_every

    def draws(self, data: DataFrame, n: int, turn: int) -> DataFrame:
        """``data`` with ``times``: how often each row is drawn in round ``turn``."""

        @F.pandas_udf("long")
        def drawn(h: pd.Series, w: pd.Series) -> pd.Series:
            uniform = (h.to_numpy().astype(np.uint64) >> np.uint64(11)) / float(1 << 53)
            return pd.Series(poisson_draws(uniform, w.to_numpy() * n))

        return data.withColumn("times", drawn(F.xxhash64(F.lit(self.seed), F.lit(turn), "key"), "w"))

    def fit(self, df: DataFrame) -> "AdaBoostR2Model":
        n = df.count()
        key = F.col("row_key") if "row_key" in df.columns else F.xxhash64(vector_to_array("features"), F.col("label"))
        data = df.select(key.alias("key"), "features", "label", F.lit(1.0 / max(n, 1)).alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
        trees, weights = [], []
        for m in range(self.n):
            drawn = self.draws(data, n, m).where("times > 0").withColumn("times", F.col("times").cast("double"))
            tree = DecisionTreeRegressor(maxDepth=3, weightCol="times", seed=self.seed).fit(drawn)
            scored = tree.transform(data).select("key", "features", "label", "w",
                                                 F.abs(F.col("label") - F.col("prediction")).alias("err"))
            mx = scored.agg(F.max("err")).first()[0]
            if mx is None or mx <= 0:
                trees.append(tree)
                weights.append(1.0)
                break
            loss = F.col("err") / F.lit(mx)
            agg = scored.agg(F.sum("w").alias("W"), F.sum(F.col("w") * loss).alias("L")).first()
            avg = agg["L"] / agg["W"]
            if avg >= 0.5:
                if not trees:
                    trees.append(tree)
                    weights.append(1.0)
                break
            beta = avg / (1 - avg)
            trees.append(tree)
            weights.append(self.lr * math.log(1 / beta))
            upd = F.col("w") * F.pow(F.lit(beta), (F.lit(1.0) - loss) * F.lit(self.lr))
            new = scored.select("key", "features", "label", upd.alias("w"))
            tot = new.agg(F.sum("w")).first()[0]
            data = _next_round(data, new.select("key", "features", "label", (F.col("w") / F.lit(tot)).alias("w")), (m + 1) % self.every == 0)
        data.unpersist()
        return AdaBoostR2Model(trees, weights)


class AdaBoostR2Model:
    def __init__(self, trees, weights):
        self.trees, self.weights = trees, weights

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        cols = []
        for i, t in enumerate(self.trees):
            t = t.copy()
            t.setPredictionCol(f"_p{i}")
            out = t.transform(out)
            cols.append(f"_p{i}")
        pairs = F.array_sort(F.array(*[F.struct(F.col(c).alias("p"), F.lit(w).alias("w"))
                                       for c, w in zip(cols, self.weights)]))
        half = 0.5 * float(sum(self.weights))
        med = F.aggregate(pairs, F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("ans")),
                          lambda acc, x: F.struct((acc["cum"] + x["w"]).alias("cum"),
                                                  F.coalesce(acc["ans"], F.when(acc["cum"] + x["w"] >= half, x["p"])).alias("ans")))
        return out.withColumn("prediction", med["ans"]).drop(*cols)

    def write(self):
        def save(path, overwrite):
            for i, t in enumerate(self.trees):
                (t.write().overwrite() if overwrite else t.write()).save(f"{path}/tree_{i}")
            _write_json(SparkSession.getActiveSession(), f"{path}/meta", {"weights": self.weights}, overwrite)
        return _Writer(save)

    @classmethod
    def load(cls, path: str) -> "AdaBoostR2Model":
        meta = _read_json(SparkSession.getActiveSession(), f"{path}/meta")
        return cls([DecisionTreeRegressionModel.load(f"{path}/tree_{i}") for i in range(len(meta["weights"]))],
                   meta["weights"])
