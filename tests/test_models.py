import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from qualab.operators import explain as X
from qualab.operators import models_custom as MC


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(0)
    Xtr, Xte = rng.normal(size=(60, 4)), rng.normal(size=(15, 4))
    ytr = rng.integers(0, 3, 60).astype(float)
    tr = spark.createDataFrame(pd.DataFrame({"row_key": [f"t{i}" for i in range(60)], "x": [list(map(float, r)) for r in Xtr], "label": ytr})) \
              .select("row_key", array_to_vector("x").alias("features"), "label")
    te = spark.createDataFrame(pd.DataFrame({"row_key": [f"q{i}" for i in range(15)], "x": [list(map(float, r)) for r in Xte], "label": 0.0})) \
              .select("row_key", array_to_vector("x").alias("features"), "label")
    got = {r["row_key"]: r["prediction"] for r in MC.KNeighbors(k=5, block_rows=17).fit(tr).transform(te).collect()}
    for i in range(15):
        d = np.sqrt(((Xtr - Xte[i]) ** 2).sum(1))
        nb = ytr[np.argsort(d, kind="stable")[:5]]
        vals, cnt = np.unique(nb, return_counts=True)
        assert got[f"q{i}"] == vals[np.argmax(cnt)]


def test_permutation_shap_exact_for_linear(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=["a", "b", "c"])
    pdf["y"] = 2 * pdf["a"] - pdf["b"] + 0.5 * pdf["c"] + 1
    pdf["row_key"] = [str(i) for i in range(80)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))
    model = LinearRegression(labelCol="y", solver="normal").fit(df)
    perm = X.permutation_shap(model, df.limit(10), ["a", "b", "c"], df, permutations=4)
    lin = X.linear_shap(df.limit(10), dict(zip(["a", "b", "c"], model.coefficients.toArray().tolist())), df)
    j = perm.alias("p").join(lin.alias("l"), ["row_key", "feature"]).select("p.shap", F.col("l.shap").alias("ls")).collect()
    assert len(j) == 30 and all(math.isclose(r[0], r[1], abs_tol=1e-9) for r in j)


def test_adaboost_samme_learns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = ((x[:, 0] + x[:, 1]) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": [list(map(float, r)) for r in x], "label": y, "row_key": [str(i) for i in range(200)]})) \
              .select("row_key", array_to_vector("x").alias("features"), "label")
    m = MC.AdaBoostSamme(n_estimators=8, checkpoint_every=4).fit(df)
    acc = m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.85


def test_adaboost_r2_equals_numpy_with_the_same_draws(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, size=(150, 2)).astype(float)      # fewer values than bins: the trees are exact
    y = 5 * np.sin(x[:, 0]) + x[:, 1] + rng.normal(size=150)
    df = spark.createDataFrame(pd.DataFrame({"row_key": [f"{i:03d}" for i in range(150)], "x": [list(map(float, r)) for r in x], "label": y})) \
              .select("row_key", array_to_vector("x").alias("features"), "label")
    boost = MC.AdaBoostR2(n_estimators=4, checkpoint_every=2)
    model = boost.fit(df)

    def depth3(rows, w, at, depth=0):
        """Predictions of the places ``at``: splits halfway between values that were drawn, the lowest of equals."""
        mean = np.average(y[rows], weights=w[rows])
        best = None
        if depth < 3 and len(set(y[rows])) > 1:
            for j in range(2):
                values = np.unique(x[np.flatnonzero(w), j])
                for t in (values[:-1] + values[1:]) / 2:
                    left = rows[x[rows, j] <= t]
                    right = rows[x[rows, j] > t]
                    if len(left) and len(right):
                        gain = sum((w[r] * (y[r] - mean)).sum() ** 2 / w[r].sum() for r in (left, right))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, j, t, left, right)
        out = np.full(len(at), mean)
        if best is not None:
            _, j, t, left, right = best
            goes_left = x[at, j] <= t
            out[goes_left] = depth3(left, w, at[goes_left], depth + 1)
            out[~goes_left] = depth3(right, w, at[~goes_left], depth + 1)
        return out

    w = np.full(150, 1 / 150)
    keyed = df.select(F.col("row_key").alias("key"))
    preds, alphas = [], []
    for turn in range(4):
        weighted = keyed.join(spark.createDataFrame([(f"{i:03d}", float(v)) for i, v in enumerate(w)], "key string, w double"), "key")
        times = np.array([r["times"] for r in boost.draws(weighted, 150, turn).orderBy("key").collect()])
        assert 100 < times.sum() < 200
        p = depth3(np.flatnonzero(times), times.astype(float), np.arange(150))
        loss = np.abs(y - p) / np.abs(y - p).max()
        avg = (w * loss).sum()
        assert avg < 0.5
        beta = avg / (1 - avg)
        preds.append(p)
        alphas.append(math.log(1 / beta))
        w = w * beta ** (1 - loss)
        w /= w.sum()
    assert np.allclose(model.weights, alphas, rtol=1e-6)
    order = np.argsort(np.array(preds), axis=0)
    half = np.cumsum(np.array(alphas)[order], axis=0) >= 0.5 * sum(alphas)
    want = np.take_along_axis(np.array(preds), np.take_along_axis(order, half.argmax(axis=0)[None], axis=0), axis=0)[0]
    got = model.transform(df).orderBy("row_key").toPandas()["prediction"]
    assert np.allclose(got, want)


def test_poisson_draws_have_their_rate():
    u = np.random.default_rng(4).random(40000)
    for rate in (0.1, 1.0, 30.0, 900.0):
        d = MC.poisson_draws(u, np.full(40000, rate))
        assert abs(d.mean() / rate - 1) < 0.05 and d.min() >= 0


def test_a_failed_model_is_no_result(spark, tmp_path, monkeypatch):
    """A model that refuses its data has no artefact and counts among the models; an error of the run is raised."""
    import pytest
    from pyspark.ml.classification import NaiveBayes

    from qualab.operators import models as MO
    from qualab.operators import rank as R

    df = spark.createDataFrame([(str(i), [float(i % 2), float(i % 3)], float(i % 2), i % 5 == 0) for i in range(60)],
                               "row_key string, x array<double>, label double, is_test boolean") \
              .select("row_key", array_to_vector("x").alias("features"), "label", "is_test")

    class Broken:
        def __init__(self, error):
            self.error = error

        def fit(self, df):
            raise self.error

    def trained(error):
        monkeypatch.setattr(MO, "make_estimator", lambda name, *_: NaiveBayes(modelType="gaussian") if name == "GaussianNB" else Broken(error))
        return MO.benchmark(df, "clasificacion", "r", models=["GaussianNB", "SVC"], cv_folds=0)

    res = trained(ValueError("these rows do not do"))
    assert [name for name, _ in res.failures] == ["SVC"]
    saved = MO.save_models(res, str(tmp_path))
    assert R.artefacts_available(saved).collect() == [("r", 1, 2, False)]
    with pytest.raises(ValueError):
        [MO.load_model(r["path"], r["kind"]) for r in saved.collect()]
    res.release()
    with pytest.raises(RuntimeError, match="lost"):
        trained(RuntimeError("a task was lost"))


def test_the_regressors_benchmark_has_all_models_and_folds(spark, sf, monkeypatch):
    from qualab.operators import models as MO
    from qualab.plans import checks_models as CM

    tried = []

    def trained(name, est, data, run_id, problem_type, cv_folds, *_, **__):
        tried.append((name, cv_folds))
        return None, data, {"r2": 0.0, "cv_mean": 0.0, "cv_std": 0.0, "train_seconds": 0.0}, None

    monkeypatch.setattr(MO, "train_one", trained)
    assert CM.m20r(spark, sf).count() == 4 * len(MO.REGRESSION_MODELS)
    assert sorted(tried) == sorted((name, 5) for name in MO.REGRESSION_MODELS) and len(tried) == 10
