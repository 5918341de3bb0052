import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from qualab.operators import metrics as M


def _binary(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n).astype(float)
    s = np.round(np.clip(y * 0.3 + rng.random(n) * 0.7, 0, 1), 2)   # rounding makes score ties
    pdf = pd.DataFrame({"run_id": "r", "model": "m", "row_key": [str(i) for i in range(n)], "label": y,
                        "prediction": (s >= 0.5).astype(float), "probability": s})
    return spark.createDataFrame(pdf), pdf


def _auc_pairs(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def test_auc_equals_pair_count(spark):
    df, pdf = _binary(spark)
    got = M.roc_auc(df).first()["auc"]
    assert math.isclose(got, _auc_pairs(pdf["label"].to_numpy(), pdf["probability"].to_numpy()), rel_tol=1e-12)


def test_auc_of_negated_score(spark):
    df, _ = _binary(spark, seed=4)
    a = M.roc_auc(df).first()["auc"]
    b = M.roc_auc(df.withColumn("probability", -F.col("probability"))).first()["auc"]
    assert math.isclose(a + b, 1.0, rel_tol=1e-12)


def test_roc_points_monotone(spark):
    df, _ = _binary(spark, seed=2)
    pts = M.roc_points(df).orderBy(F.col("threshold").desc_nulls_first()).toPandas()
    assert pts["fpr"].is_monotonic_increasing and pts["tpr"].is_monotonic_increasing
    assert pts.iloc[-1][["fpr", "tpr"]].tolist() == [1.0, 1.0]


def test_classification_metrics_weighted(spark):
    rows = [("r", "m", str(i), float(y), float(p), None) for i, (y, p) in
            enumerate([(0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 0), (2, 1)])]
    df = spark.createDataFrame(rows, "run_id string, model string, row_key string, label double, prediction double, probability double")
    r = M.classification_metrics(df).first()
    # per class: precision 0:1/2 1:2/4 2:1  recall 0:1/2 1:1 2:1/3  support 2,2,3
    p = (2 * 0.5 + 2 * 0.5 + 3 * 1.0) / 7
    rc = (2 * 0.5 + 2 * 1.0 + 3 * (1 / 3)) / 7
    assert math.isclose(r["accuracy"], 4 / 7) and math.isclose(r["precision"], p) and math.isclose(r["recall"], rc)


def test_regression_metrics(spark):
    y = np.array([1.0, 2.0, 4.0, 8.0])
    p = np.array([1.5, 2.0, 3.0, 9.0])
    df = spark.createDataFrame([("r", "m", str(i), float(a), float(b), None) for i, (a, b) in enumerate(zip(y, p))],
                               "run_id string, model string, row_key string, label double, prediction double, probability double")
    r = M.regression_metrics(df).first()
    assert math.isclose(r["mse"], np.mean((y - p) ** 2)) and math.isclose(r["mae"], np.mean(np.abs(y - p)))
    assert math.isclose(r["r2"], 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_confusion_normalized_rows_sum_to_one(spark):
    df, _ = _binary(spark, seed=5)
    cm = M.confusion_matrix(df, normalize="true").groupBy("label").agg(F.sum("value").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in cm)


def test_residual_slices_match_numpy(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(100, 10, 203)
    p = y + np.round(rng.normal(0, 3, 203), 1)
    df = spark.createDataFrame([("r", "m", str(i), float(a), float(b), None) for i, (a, b) in enumerate(zip(y, p))],
                               "run_id string, model string, row_key string, label double, prediction double, probability double")
    r = M.residual_diagnosis(df).first()
    e = np.sort(y - p)
    n = len(e)
    v = [np.var(e[i * n // 5:(i + 1) * n // 5]) for i in range(5)]
    assert math.isclose(r["variance_ratio"], max(v) / min(v), rel_tol=1e-9)
    assert math.isclose(r["median"], float(np.median(e))) and math.isclose(r["std"], float(np.std(e)))
    assert 0.0 <= r["normal_p"] <= 1.0


def test_inverse_normal(spark):
    df = spark.createDataFrame([(0.001,), (0.025,), (0.5,), (0.975,), (0.9999,)], "p double")
    got = [r[0] for r in df.select(M.inverse_normal(F.col("p"))).collect()]
    exp = [-3.090232306, -1.959963985, 0.0, 1.959963985, 3.719016485]
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, exp))
