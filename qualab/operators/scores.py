"""Class scores of trained models (E2, E6, E7, M20) and their calibration (M5).

``class_scores`` gives the long table (run_id, model, row_key, label, class, score) that the one-vs-rest metrics
read: the model's probabilities where it has them, else its one-vs-rest margins, calibrated per class by a
logistic curve and scaled to a sum of one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ["run_id", "model", "row_key", "label", "class", "score"]


def _sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def logistic_curves(margins: DataFrame, max_classes: int = 1000, iterations: int = 50, tolerance: float = 1e-9) -> dict[float, tuple[float, float]]:
    """class → (a, b) of P(class | margin) = 1 / (1 + exp(-(a·margin + b))), the likelihood's maximum over the rows
    (class, margin, hit) with targets (n₊+1)/(n₊+2) and 1/(n₋+2) in place of 1 and 0, which keeps it finite.

    Newton steps with halving; each iteration is one aggregate for all classes (one row a class reaches the driver)."""
    rows = margins.select(F.col("class").cast("double").alias("class"), F.col("margin").cast("double").alias("m"),
                          F.col("hit").cast("boolean").alias("hit")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = rows.groupBy("class").agg(F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("n"),
                                          F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd")).limit(max_classes + 1).collect()
        if len(start) > max_classes:
            raise ValueError(f"more than max_classes={max_classes} classes")
        state = {}
        for r in start:                           # margins are centred and scaled for the steps
            hi, lo = (r["p"] + 1.0) / (r["p"] + 2.0), 1.0 / (r["n"] + 2.0)
            state[r["class"]] = {"hi": hi, "lo": lo, "mean": r["mean"], "sd": r["sd"] or 1.0, "a": 0.0,
                                 "b": math.log((r["p"] + 1.0) / (r["n"] + 1.0)), "loss": math.inf, "step": None, "done": False}
        for _ in range(iterations):
            active = {c: s for c, s in state.items() if not s["done"]}
            if not active:
                break
            table = rows.sparkSession.createDataFrame(
                [(c, s["a"], s["b"], s["hi"], s["lo"], s["mean"], s["sd"]) for c, s in active.items()],
                "class double, a double, b double, hi double, lo double, mean double, sd double")
            x = (F.col("m") - F.col("mean")) / F.col("sd")
            one = rows.join(F.broadcast(table), "class").select("class", x.alias("x"), (F.col("a") * x + F.col("b")).alias("z"),
                                                                F.when(F.col("hit"), F.col("hi")).otherwise(F.col("lo")).alias("t"))
            p, z = _sigmoid(F.col("z")), F.col("z")
            w, g = p * (1 - p), p - F.col("t")
            loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("t") * z
            sums = one.groupBy("class").agg(F.sum(loss).alias("loss"), F.sum(g * F.col("x")).alias("ga"), F.sum(g).alias("gb"),
                                            F.sum(w * F.col("x") * F.col("x")).alias("haa"), F.sum(w * F.col("x")).alias("hab"), F.sum(w).alias("hbb"))
            for r in sums.collect():
                s = state[r["class"]]
                if r["loss"] > s["loss"] * (1 + 1e-12) and s["step"] is not None:
                    s["step"] = (s["step"][0] / 2, s["step"][1] / 2)                 # back half of the last step
                    s["a"], s["b"] = s["a"] + s["step"][0], s["b"] + s["step"][1]
                    s["done"] = max(map(abs, s["step"])) < tolerance
                    continue
                s["loss"] = r["loss"]
                haa, hab, hbb = r["haa"] + 1e-10, r["hab"], r["hbb"] + 1e-10
                det = haa * hbb - hab * hab
                da, db = (hbb * r["ga"] - hab * r["gb"]) / det, (haa * r["gb"] - hab * r["ga"]) / det
                s["a"], s["b"], s["step"] = s["a"] - da, s["b"] - db, (da, db)
                s["done"] = max(abs(da), abs(db)) < tolerance
        return {c: (s["a"] / s["sd"], s["b"] - s["a"] * s["mean"] / s["sd"]) for c, s in state.items()}
    finally:
        rows.unpersist()


def one_vs_rest_margins(scored: DataFrame, classes: Sequence[float], raw: str = "rawPrediction") -> DataFrame:
    """(class, margin, hit) of every row and class from a vector with one margin a class."""
    m = vector_to_array(raw)
    return scored.select(F.inline(F.array(*[F.struct(F.lit(float(c)).alias("class"), m[j].alias("margin"),
                                                     (F.col("label") == F.lit(float(c))).alias("hit")) for j, c in enumerate(classes)])))


def calibrated(margins: Sequence[Column], curves: Sequence[tuple[float, float]]) -> Column:
    """The margins' probabilities, scaled to a sum of one (equal shares where all are zero)."""
    p = F.array(*[_sigmoid(F.lit(a) * m + F.lit(b)) for m, (a, b) in zip(margins, curves)])
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(F.transform(p, lambda x: F.lit(1.0 / len(curves))))


def class_scores(model, data: DataFrame, run_id: str, name: str, classes: Sequence[float], train: DataFrame | None = None) -> DataFrame:
    """(run_id, model, row_key, label, class, score) of every row of ``data`` and class.

    A model with ``probability`` gives it, in the order of ``classes`` (or of ``model.classes``).  One with margins
    alone (one-vs-rest) is calibrated on ``train``.  Classes that the model does not know score 0."""
    known = [float(c) for c in (getattr(model, "classes", None) or classes)]
    if not getattr(model, "classes", None):          # a Spark model scores the labels 0, 1, ... that it was trained on
        known = known[: getattr(model, "numClasses", None) or len(getattr(model, "models", known))]
    out = model.transform(data)
    if "probability" in out.columns:
        score = vector_to_array("probability")
    elif "rawPrediction" in out.columns:
        if train is None:
            raise ValueError("margins need training rows for their calibration")
        curves = logistic_curves(one_vs_rest_margins(model.transform(train), known))
        raw = vector_to_array("rawPrediction")
        score = calibrated([raw[j] for j in range(len(known))], [curves.get(c, (0.0, 0.0)) for c in known])
    else:
        raise ValueError(f"{type(model).__name__} has neither probabilities nor margins")
    listed = F.array(*[F.struct(F.lit(float(c)).alias("class"),
                                (F.get("_s", F.lit(known.index(c))) if c in known else F.lit(0.0)).cast("double").alias("score"))
                       for c in sorted({*map(float, classes), *known})])
    return out.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("model"), "row_key", F.col("label").cast("double").alias("label"),
                      score.alias("_s")).select("run_id", "model", "row_key", "label", F.inline(listed))
