"""RBF kernel machines (M5 SVC with probabilities, M16 SVR) on Nyström features.

The kernel's feature space is cut down to the span of ``components`` landmarks, the distinct training vectors of
least hash; with as many landmarks as distinct rows it is the exact kernel.  In that space the machine's own
objective is minimised, ½|w|² + C·Σ loss (hinge; ε-insensitive for regression), with a free intercept.  The loss's
corner is rounded over a width that shrinks to ``SMOOTH`` of the loss's scale, which bounds the distance from the
optimum: at most C·n·width/2.  Each damped Newton step is one pass over the rows; all classes (one against the
rest) and all calibration folds take their steps in the same pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualab.functions.arrow import matrix
from qualab.operators.models_custom import _read_json, _write_json, _Writer
from qualab.operators.scores import calibrated, logistic_curves

SMOOTH = 4e-3          # width of the rounded corner at the end, as a share of the loss's scale
MAX_PASSES = 150
SETTLED, SETTLED_LAST = 3e-2, 1e-4    # relative fall of the objective at which a width, and the last width, is left
NARROW = 8                            # a width is this many times the next
EASE, HARDEN, DAMPING = 3, 20, 1e-3   # damping after a step that was kept, one that was not, and at a new width
COLLECT_NUMBERS = 1 << 24


@dataclass
class Landmarks:
    """z(x) = k(x, points)·root has the kernel of the points' span as inner product."""

    points: np.ndarray
    gamma: float
    root: np.ndarray

    @classmethod
    def fit(cls, x: DataFrame, components: int) -> "Landmarks":
        """From the array column ``x``; γ = 1 / (d·Var(X)), the variance over all numbers of all rows."""
        s = x.select(F.size("x").alias("d"), F.explode("x").alias("v")).agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).first()
        if s["d"] is None:
            raise ValueError("no training rows")
        points = matrix(x.distinct().orderBy(F.xxhash64("x"), "x").limit(components).toArrow()["x"])
        out = cls(points, 1.0 / (s["d"] * s["v"]) if s["v"] else 1.0, np.zeros((0, 0)))
        values, vectors = np.linalg.eigh(out.kernel(points))
        keep = values > 1e-10 * values[-1]
        out.root = vectors[:, keep] / np.sqrt(values[keep])
        return out

    def kernel(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] - 2.0 * x @ self.points.T + (self.points * self.points).sum(axis=1)
        return np.exp(-self.gamma * np.maximum(d, 0.0))


@dataclass
class Problem:
    """One machine: class ``cls`` against the rest (None: regression), without the rows of ``fold``."""

    cls: float | None
    fold: int | None
    at: np.ndarray                       # w and, last, the intercept
    width: float
    loss: float = math.inf
    grad: np.ndarray = field(default=None, repr=False)
    curve: np.ndarray = field(default=None, repr=False)
    bound: np.ndarray = field(default=None, repr=False)
    best: np.ndarray = field(default=None, repr=False)
    damping: float = DAMPING
    done: bool = False


def _measure(rows: DataFrame, problems: list[Problem], cost: float, epsilon: float, parts: int) -> list[np.ndarray]:
    """Of each problem, in one pass: the rounded loss and its gradient, a bound of the curvature's diagonal, and the
    curvature (rows of one matrix)."""
    held = rows.sparkSession.sparkContext.broadcast([(p.cls, p.fold, p.at, p.width) for p in problems])
    size = len(problems[0].at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        total = np.zeros((len(asked), size + 2, size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.concatenate([matrix(batch.column("z")), np.ones((batch.num_rows, 1))], axis=1)
            y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for q, (cls, out, at, width) in enumerate(asked):
                some = slice(None) if out is None else fold != out
                total[q] += rounded_loss(z[some], y[some], cls, at, width, epsilon)
        flat = total.reshape(len(asked) * (size + 2), -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(list(flat), pa.list_(pa.float64()))], names=["i", "v"])

    sums = rows.select("z", "label", "fold").mapInArrow(run, "i int, v array<double>")
    if parts * len(problems) * (size + 2) ** 2 > COLLECT_NUMBERS:      # added up by row first

        def add(part):
            return pa.table({"i": part["i"].slice(0, 1), "v": pa.array([matrix(part["v"]).sum(axis=0)], pa.list_(pa.float64()))})

        sums = sums.groupBy("i").applyInArrow(add, "i int, v array<double>")
    found = sums.toArrow()
    total = np.zeros((len(problems) * (size + 2), size + 1))
    np.add.at(total, found["i"].to_numpy(), matrix(found["v"]))
    return list(cost * total.reshape(len(problems), size + 2, -1))


def rounded_loss(z: np.ndarray, y: np.ndarray, cls: float | None, at: np.ndarray, width: float, epsilon: float) -> np.ndarray:
    """The rows' share of what ``_measure`` adds up: row 0 the loss and the gradient, row 1 the bound, then the curvature."""
    size, f = len(at), z @ at
    if cls is None:
        side, t = np.where(y >= f, 1.0, -1.0), np.abs(y - f) - epsilon
    else:
        side = np.where(y == cls, 1.0, -1.0)
        t = 1.0 - side * f
    out = np.zeros((size + 2, size + 1))
    on = t > 0
    side, t, z = side[on], t[on], z[on]
    corner = z[t < width]
    out[0, 0] = np.where(t < width, t * t / (2 * width), t - width / 2).sum()
    out[0, 1:] = -((side * np.minimum(t / width, 1.0))[:, None] * z).sum(axis=0)
    out[1, 1:] = (z ** 2).sum(axis=0) / width
    out[2:, 1:] = corner.T @ corner / width
    return out


def _step(p: Problem, measured: np.ndarray, least_width: float) -> None:
    """Keeps or takes back the problem's last step, then takes the next one, narrows the corner, or ends."""
    ridge = np.append(np.ones(len(p.at) - 1), 0.0)
    value = measured[0, 0] + 0.5 * (ridge * p.at ** 2).sum()
    fall = p.loss - value
    if fall >= 0:
        p.loss, p.best = value, p.at
        p.grad, p.bound, p.curve = measured[0, 1:] + ridge * p.at, measured[1, 1:] + ridge, measured[2:, 1:] + np.diag(ridge)
        p.damping = max(p.damping / EASE, 1e-10)
    else:
        p.damping *= HARDEN
    if p.damping > 1e3 or 0 <= fall <= (SETTLED_LAST if p.width <= least_width else SETTLED) * abs(value):
        p.at, p.damping = p.best, DAMPING
        p.done = p.width <= least_width
        p.width, p.loss = max(p.width / NARROW, least_width), math.inf if not p.done else p.loss
        return                                                    # the same point is measured with the new width
    p.at = p.best - np.linalg.solve(p.curve + np.diag(p.damping * p.bound + 1e-12), p.grad)


def solve(rows: DataFrame, problems: list[Problem], cost: float, epsilon: float, scale: float) -> None:
    """Minimises all ``problems`` over the rows (z, label, fold)."""
    parts = rows.select(F.spark_partition_id().alias("p")).agg(F.count_distinct("p")).first()[0]
    for _ in range(MAX_PASSES):
        active = [p for p in problems if not p.done]
        if not active:
            return
        for p, measured in zip(active, _measure(rows, active, cost, epsilon, parts)):
            _step(p, measured, SMOOTH * scale)
    for p in problems:
        p.at = p.best if p.best is not None else p.at


def _features(df: DataFrame, landmarks: Landmarks, folds: int) -> DataFrame:
    """(z, label, fold) of the training rows."""
    held = df.sparkSession.sparkContext.broadcast(landmarks)
    key = F.col("row_key") if "row_key" in df.columns else vector_to_array("features")
    rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"),
                     F.pmod(F.xxhash64(F.lit(17), key), F.lit(max(folds, 1))).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = held.value.kernel(matrix(batch.column("x"))) @ held.value.root
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("label"), batch.column("fold")], names=["z", "label", "fold"])

    return rows.mapInArrow(run, "z array<double>, label double, fold int")


class KernelSVC:
    """M5: soft-margin SVC (C = ``cost``), one against the rest for more than two classes.  Probabilities are logistic
    curves of margins that each row gets from a machine trained without its fold (``folds``)."""

    def __init__(self, cost: float = 1.0, components: int = 100, folds: int = 3, max_classes: int = 100):
        self.cost, self.components, self.folds, self.max_classes = cost, components, folds, max_classes

    def fit(self, df: DataFrame) -> "KernelModel":
        landmarks = Landmarks.fit(df.select(vector_to_array("features").alias("x")), self.components)
        rows = _features(df, landmarks, self.folds).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            classes = [float(r[0]) for r in rows.select("label").distinct().orderBy("label").limit(self.max_classes + 1).collect()]
            if len(classes) > self.max_classes:
                raise ValueError(f"more than max_classes={self.max_classes} classes")
            shown = classes[1:] if len(classes) == 2 else classes
            start = np.zeros(landmarks.root.shape[1] + 1)
            whole = [Problem(c, None, start, 2.0) for c in shown]
            parts = [Problem(c, f, start, 2.0) for c in shown for f in range(self.folds)] if self.folds > 1 else []
            solve(rows, [*whole, *parts], self.cost, 0.0, 1.0)
            curves = self._curves(rows, shown, parts or whole)
        finally:
            rows.unpersist()
        return KernelModel(landmarks, np.array([p.at for p in whole]), classes, [curves.get(c, (1.0, 0.0)) for c in shown],
                           [p.loss for p in whole])

    @staticmethod
    def _curves(rows: DataFrame, shown: list[float], problems: list[Problem]) -> dict:
        held = rows.sparkSession.sparkContext.broadcast([(p.cls, p.fold, p.at) for p in problems])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                z = np.concatenate([matrix(batch.column("z")), np.ones((batch.num_rows, 1))], axis=1)
                y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
                for cls, out, at in held.value:
                    of = np.flatnonzero(fold == out) if out is not None else np.arange(len(y))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), cls)), pa.array(z[of] @ at), pa.array(y[of] == cls)],
                                                     names=["class", "margin", "hit"])

        return logistic_curves(rows.mapInArrow(run, "class double, margin double, hit boolean"))


class KernelSVR:
    """ε-insensitive support vector regression (C = ``cost``)."""

    def __init__(self, cost: float = 1.0, epsilon: float = 0.1, components: int = 100):
        self.cost, self.epsilon, self.components = cost, epsilon, components

    def fit(self, df: DataFrame) -> "KernelModel":
        landmarks = Landmarks.fit(df.select(vector_to_array("features").alias("x")), self.components)
        rows = _features(df, landmarks, 1).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            s = rows.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
            scale = s["s"] or 1.0
            one = Problem(None, None, np.append(np.zeros(landmarks.root.shape[1]), s["m"]), scale)
            solve(rows, [one], self.cost, self.epsilon, scale)
        finally:
            rows.unpersist()
        return KernelModel(landmarks, one.at[None, :], None, None, [one.loss])


class KernelModel:
    """Margins are k(x, landmarks)·coefficients + intercept.  Columns: ``prediction``; for classes ``rawPrediction``
    (a margin a class) and ``probability`` too."""

    def __init__(self, landmarks: Landmarks, at: np.ndarray, classes: list[float] | None, curves: list | None, objective: list[float]):
        self.landmarks, self.at, self.classes, self.curves, self.objective = landmarks, at, classes, curves, objective

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.landmarks.kernel(x) @ (self.landmarks.root @ self.at[:, :-1].T) + self.at[:, -1]

    def transform(self, df: DataFrame) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            return pd.Series(list(held.value.margins(np.stack(x.to_numpy()).astype(float)))) if len(x) else x

        out = df.withColumn("_m", margins(vector_to_array("features")))
        if self.classes is None:
            return out.withColumn("prediction", F.get("_m", F.lit(0))).drop("_m")
        m = [F.get("_m", F.lit(j)) for j in range(len(self.at))]
        names = F.array(*[F.lit(c) for c in self.classes])
        if len(self.classes) == 2:
            raw = F.array(-m[0], m[0])
            p = 1.0 / (1.0 + F.exp(-(F.lit(self.curves[0][0]) * m[0] + F.lit(self.curves[0][1]))))
            probability = F.array(1.0 - p, p)
        else:
            raw, probability = F.array(*m), calibrated(m, self.curves)
        return out.withColumn("prediction", F.element_at(names, F.array_position(raw, F.array_max(raw)).cast("int"))) \
                  .withColumn("rawPrediction", array_to_vector(raw)).withColumn("probability", array_to_vector(probability)).drop("_m")

    def write(self):
        def save(path, overwrite):
            g = self.landmarks
            _write_json(SparkSession.getActiveSession(), f"{path}/meta",
                        {"points": g.points.tolist(), "gamma": g.gamma, "root": g.root.tolist(), "at": self.at.tolist(),
                         "classes": self.classes, "curves": self.curves, "objective": self.objective}, overwrite)
        return _Writer(save)

    @classmethod
    def load(cls, path: str) -> "KernelModel":
        m = _read_json(SparkSession.getActiveSession(), f"{path}/meta")
        return cls(Landmarks(np.array(m["points"]), m["gamma"], np.array(m["root"])), np.array(m["at"]), m["classes"], m["curves"], m["objective"])
