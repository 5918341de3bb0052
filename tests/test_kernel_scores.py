"""Kernel machines against the exact kernel's bounds, calibration, class scores, concurrent fits."""

import threading
import time

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from qualab.functions.pool import run_jobs
from qualab.operators import crossval as C
from qualab.operators import kernel as K
from qualab.operators import metrics as M
from qualab.operators import models as MO
from qualab.operators import models_custom as MC
from qualab.operators import scores as S


def vectors(spark, x, y, test=None):
    rows = [(f"r{i:05d}", [float(v) for v in r], float(t), bool(i % 4 == 0)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_key string, x array<double>, label double, is_test boolean") \
                .select("row_key", array_to_vector("x").alias("features"), "label", "is_test")


def rbf(x, gamma):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return np.exp(-gamma * d)


def test_svc_reaches_the_bound_of_the_exact_dual(spark):
    """Weak duality: any α in [0, C] with Σαy = 0 bounds the optimum from below; the machine's objective is 6 % above this one at most."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(160, 3))
    y = ((x ** 2).sum(axis=1) + 0.6 * rng.normal(size=160) > 2.5).astype(float)
    model = K.KernelSVC(components=200, folds=1).fit(vectors(spark, x, y))
    gram = rbf(x, model.landmarks.gamma)
    assert abs(model.landmarks.gamma - 1 / (3 * x.var())) < 1e-12
    sign = np.where(y == 1, 1.0, -1.0)
    f = model.margins(x)[:, 0]
    w = model.at[0, :-1]
    primal = 0.5 * w @ w + np.maximum(0, 1 - sign * f).sum()
    alpha = np.clip((1 - sign * f) / K.SMOOTH, 0, 1)
    for s in (1.0, -1.0):                            # the heavier side is scaled down to Σαy = 0
        if (alpha * sign).sum() * s > 0:
            heavy = sign == s
            alpha[heavy] *= 1 - (alpha * sign).sum() * s / alpha[heavy].sum()
    dual = alpha.sum() - 0.5 * (alpha * sign) @ gram @ (alpha * sign)
    assert abs((alpha * sign).sum()) < 1e-8 and dual <= primal * (1 + 1e-9) and primal - dual < 0.06 * primal


def test_svr_reaches_the_bound_of_the_exact_dual(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, size=(150, 2))
    y = 3 * np.sin(x[:, 0]) + x[:, 1] + 0.2 * rng.normal(size=150)
    model = K.KernelSVR(components=200).fit(vectors(spark, x, y))
    f = model.margins(x)[:, 0]
    w = model.at[0, :-1]
    primal = 0.5 * w @ w + np.maximum(0, np.abs(y - f) - 0.1).sum()
    beta = np.sign(y - f) * np.clip((np.abs(y - f) - 0.1) / (K.SMOOTH * y.std()), 0, 1)
    for s in (1.0, -1.0):
        if beta.sum() * s > 0:
            heavy = np.sign(beta) == s
            beta[heavy] *= 1 - beta.sum() * s / np.abs(beta[heavy]).sum()
    dual = beta @ y - 0.1 * np.abs(beta).sum() - 0.5 * beta @ rbf(x, model.landmarks.gamma) @ beta
    assert abs(beta.sum()) < 1e-8 and dual <= primal * (1 + 1e-9) and primal - dual < 0.06 * primal
    assert np.abs(f - y).mean() < 0.35


def test_svc_probabilities_are_calibrated_on_rows_not_seen(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1600, 2))
    p = 1 / (1 + np.exp(-2 * (x[:, 0] + x[:, 1] ** 2 - 1)))
    y = (rng.random(1600) < p).astype(float)
    df = vectors(spark, x, y)
    model = K.KernelSVC(components=60).fit(df.where("not is_test"))
    out = model.transform(df.where("is_test")).orderBy("row_key").toPandas()
    got = np.stack([v.toArray()[1] for v in out["probability"]])
    held = np.arange(0, 1600, 4)
    assert np.abs(got - p[held]).mean() < 0.12 and abs(got.mean() - y[held].mean()) < 0.06
    for lo, hi in ((0.0, 0.35), (0.35, 0.65), (0.65, 1.0)):
        part = (got >= lo) & (got <= hi)
        assert abs(got[part].mean() - p[held][part].mean()) < 0.1
    model.write().overwrite().save(f"{tmp_path}/svc")
    back = K.KernelModel.load(f"{tmp_path}/svc").transform(df.where("is_test")).orderBy("row_key").toPandas()
    assert (back["prediction"] == out["prediction"]).all()


def test_svc_of_three_classes(spark):
    rng = np.random.default_rng(3)
    centers = np.array([[0, 0], [3, 0], [0, 3]])
    y = rng.integers(0, 3, 400)
    df = vectors(spark, centers[y] + rng.normal(size=(400, 2)) * 0.7, y)
    model = K.KernelSVC(components=40).fit(df.where("not is_test"))
    scores = S.class_scores(model, df.where("is_test"), "r", "SVC", [0, 1, 2])
    assert M.multiclass_auc(scores).first()["macro_auc"] > 0.97
    sums = scores.groupBy("row_key").agg(F.sum("score").alias("s"), F.count("*").alias("n")).agg(F.min("s"), F.max("s"), F.min("n"), F.max("n")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9 and sums[2] == sums[3] == 3


def test_logistic_curves_reach_the_maximum(spark):
    rng = np.random.default_rng(4)
    rows, data = [], {}
    for c, (a, b, n) in {0.0: (2.0, -1.0, 400), 1.0: (30.0, 5.0, 300), 2.0: (0.0, 0.0, 50)}.items():
        m = rng.normal(size=n) * (1 if c < 2 else 1e4)
        hit = rng.random(n) < 1 / (1 + np.exp(-(a * m + b)))
        hit = m > 0 if c == 1.0 else hit                  # separable: the softened targets keep it finite
        rows += [(c, float(v), bool(h)) for v, h in zip(m, hit)]
        data[c] = (m, hit)
    curves = S.logistic_curves(spark.createDataFrame(rows, "class double, margin double, hit boolean"))
    for c, (m, hit) in data.items():
        t = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))
        p = 1 / (1 + np.exp(-np.clip(curves[c][0] * m + curves[c][1], -700, 700)))
        assert abs(((p - t) * m).sum()) < 1e-4 * np.abs(m).sum() and abs((p - t).sum()) < 1e-4 * len(m)


def test_scores_of_margins_and_of_votes(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 300)
    x = np.eye(4)[y] * 2 + rng.normal(size=(300, 4))
    df = vectors(spark, x, y)
    train, test = df.where("not is_test"), df.where("is_test")
    ovr = OneVsRest(classifier=LogisticRegression(maxIter=20)).fit(train)
    with pytest.raises(ValueError):
        S.class_scores(ovr, test, "r", "ovr", range(4))
    models = {"ovr": ovr, "knn": MC.KNeighbors(k=7).fit(train), "samme": MC.AdaBoostSamme(n_estimators=5).fit(train)}
    for name, model in models.items():
        scores = S.class_scores(model, test, "r", name, range(5), train)      # class 4 is in no row: score 0
        held = scores.toPandas()
        assert len(held) == 75 * 5 and (held[held["class"] == 4]["score"] == 0).all()
        assert np.allclose(held.groupby("row_key")["score"].sum(), 1)
        assert M.multiclass_auc(scores.where("class < 4")).first()["macro_auc"] > (0.6 if name == "samme" else 0.85)


def test_benchmark_carries_the_auc_of_many_classes(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 240)
    df = vectors(spark, np.eye(3)[y] + 0.5 * rng.normal(size=(240, 3)), y)
    res = MO.benchmark(df, "clasificacion", "r", models=["LogisticRegression", "GaussianNB"], cv_folds=2)
    assert not res.failures
    got = {(r["model"], r["metric"]): r["value"] for r in res.run_metrics.collect()}
    assert all(got[m, "auc"] > 0.8 and 0 < got[m, "cv_mean"] <= 1 for m in ("LogisticRegression", "GaussianNB"))
    res.release()


def test_folds_without_a_score_are_none(spark):
    df = spark.range(20).withColumn("fold", (F.col("id") % 4).cast("int"))
    scores = C.cv_scores(df, lambda train, val: None if val.count() and val.first()["fold"] == 2 else train.count(), 5)
    assert scores == [(0, 15.0), (1, 15.0), (2, None), (3, 15.0), (4, 20.0)]
    assert C.mean_and_std([1.0, None, 3.0]) == (2.0, 1.0) and C.mean_and_std([None]) == (None, None)


def test_jobs_run_at_once_and_keep_their_order(spark):
    running, most, lock = 0, 0, threading.Lock()

    def job(i):
        def run():
            nonlocal running, most
            with lock:
                running += 1
                most = max(most, running)
            time.sleep(0.2)
            out = spark.range(i).count()
            with lock:
                running -= 1
            return out
        return run

    assert run_jobs(spark, [job(i) for i in range(9)], 3) == list(range(9)) and most == 3
    with pytest.raises(ZeroDivisionError):
        run_jobs(spark, [job(1), lambda: 1 / 0, job(2)], 2)
