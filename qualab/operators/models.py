"""Model training and benchmarking on Spark ML.

Features are prepared once (F1, F7-F9), assembled into a vector and persisted; every model
is a Spark ML estimator fitted on the distributed training split.  The benchmark loop runs on
the driver but only fits, scores and collects per-model metric rows (a handful of numbers).
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualab.functions.columns import is_numeric, is_text, qcol
from qualab.functions.hashing import row_key
from qualab.operators import features as FE
from qualab.operators import metrics as M
from qualab.functions.pool import PARALLELISM, run_jobs
from qualab.operators.kernel import KernelSVC, KernelSVR
from qualab.operators.scores import class_scores
from qualab.operators.trees import DeepTrees

SEED = 42
MAX_CLASSES = 1000       # classes that a benchmark's scores are listed for
# Model names of the benchmark, in the reference's order.
CLASSIFICATION_MODELS = ["LogisticRegression", "DecisionTree", "RandomForest", "GradientBoosting", "SVC",
                         "KNeighbors", "GaussianNB", "AdaBoost"]
REGRESSION_MODELS = ["LinearRegression", "Ridge", "Lasso", "ElasticNet", "DecisionTree", "RandomForest",
                     "GradientBoosting", "SVR", "KNeighbors", "AdaBoost"]


# --------------------------------------------------------------------------- data
def prepare_model_data(df: DataFrame, target: str, problem_type: str, key_cols: Sequence[str],
                       predictors: Sequence[str] | None = None, test_size: float = 0.2, seed: int = SEED,
                       impute_on: str = "train", max_categories: int = FE.MAX_CATEGORIES) -> tuple[DataFrame, dict]:
    """F1 + F7 + F8 + F9 + assembly → (row_key, features, label, is_test) and the fitted state
    (feature names, scaler, labels).  Imputation means and scaling are fitted on the training
    split (``impute_on='all'`` reproduces the reference's leak)."""
    keyed = FE.split_flag(df, key_cols, test_size, seed).withColumn("row_key", row_key(key_cols))
    preds = [c for c in (predictors or df.columns) if c in df.columns and c != target and c not in key_cols] \
        or [c for c in df.columns if c != target and c not in key_cols]
    base = keyed.select("row_key", "is_test", qcol(target).alias("_y"), *[qcol(c) for c in preds])
    fit_df = base.where(~F.col("is_test")) if impute_on == "train" else base
    carry = ["row_key", "is_test", "_y"]
    x_full = FE.prepare_for_ml(base, fit_df, keep=carry, max_categories=max_categories)
    feat = [c for c in x_full.columns if c not in carry]
    scaler = FE.fit_scaler(x_full.where(~F.col("is_test")), feat)
    scaled = FE.apply_scaler(x_full, scaler)
    state = {"features": feat, "scaler": scaler, "labels": None, "target": target, "problem_type": problem_type}
    ydt = df.schema[target].dataType
    if problem_type == "clasificacion" and not is_numeric(ydt):
        labels = FE.fit_labels(scaled.where(~F.col("is_test")), "_y")
        state["labels"] = labels
        scaled = FE.encode_labels(scaled, "_y", labels, "label")
    else:
        scaled = scaled.withColumn("label", F.col("_y").cast("double"))
    assembled = VectorAssembler(inputCols=feat, outputCol="features", handleInvalid="keep").transform(scaled)
    out = assembled.where(F.col("label").isNotNull()).select("row_key", "features", "label", "is_test")
    return out, state


# --------------------------------------------------------------------------- estimators
class PenalisedRegression:
    """Least squares with penalties in the units of the label:
    Σ(y − xw)²/(2n) + l1·|w| + (l2/2)·w², the l2 part divided by n if ``per_row``.

    Spark ML fits the label divided by its standard deviation s and divides the penalty by s:
    the l1 part keeps its weight, the l2 part ends up divided by s.  The two parts are set so
    that both come out as asked."""

    def __init__(self, l1: float = 0.0, l2: float = 0.0, per_row: bool = False):
        self.l1, self.l2, self.per_row = l1, l2, per_row

    def fit(self, df: DataFrame):
        first = df.select("features").first()
        # the normal-equation solver (up to 4096 features) takes the population's standard deviation
        small = first is not None and first["features"].size <= 4096
        spread = F.stddev_pop if small else F.stddev_samp
        row = df.agg(spread("label").alias("s"), F.count("label").alias("n")).first()
        s = row["s"] if row["s"] and math.isfinite(row["s"]) else 1.0
        l2 = self.l2 * s / (max(row["n"], 1) if self.per_row else 1)
        total = self.l1 + l2
        return LinearRegression(regParam=total, elasticNetParam=self.l1 / total, standardization=False,
                                solver="normal" if small else "l-bfgs", maxIter=1000, tol=1e-10).fit(df)


def make_estimator(name: str, problem_type: str, n_train: int, n_classes: int = 2, seed: int = SEED):
    """One estimator of the benchmark with the reference's hyper-parameters mapped to Spark ML.

    Linear models are fitted on already-scaled features (``standardization=False``);
    L2 penalties use regParam = 1/(C·n) (logistic) and α/n (ridge) to match the per-sample
    objectives of the reference's library."""
    from qualab.operators import models_custom as MC
    n = max(n_train, 1)
    if problem_type == "clasificacion":
        if name == "LogisticRegression":
            return LogisticRegression(maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
        if name == "DecisionTree":
            return DeepTrees(problem_type, seed=seed)
        if name == "RandomForest":
            return DeepTrees(problem_type, trees=100, features="sqrt", bootstrap=True, seed=seed)
        if name == "GradientBoosting":
            gbt = GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed)
            return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)
        if name == "SVC":
            return KernelSVC()
        if name == "KNeighbors":
            return MC.KNeighbors(k=5, problem_type=problem_type)
        if name == "GaussianNB":
            return NaiveBayes(modelType="gaussian")
        if name == "AdaBoost":
            return MC.AdaBoostSamme(n_estimators=50, seed=seed)
    else:
        if name == "LinearRegression":
            return LinearRegression(solver="normal", standardization=False)
        if name == "Ridge":
            return PenalisedRegression(l2=1.0, per_row=True)
        if name == "Lasso":
            return PenalisedRegression(l1=1.0)
        if name == "ElasticNet":
            return PenalisedRegression(l1=0.5, l2=0.5)
        if name == "DecisionTree":
            return DeepTrees(problem_type, seed=seed)
        if name == "RandomForest":
            return DeepTrees(problem_type, trees=100, bootstrap=True, seed=seed)
        if name == "GradientBoosting":
            return GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed)
        if name == "SVR":
            return KernelSVR()
        if name == "KNeighbors":
            return MC.KNeighbors(k=5, problem_type=problem_type)
        if name == "AdaBoost":
            return MC.AdaBoostR2(n_estimators=50, seed=seed)
    raise ValueError(f"unknown model {name!r} for {problem_type}")


def predictions_of(model, data: DataFrame, run_id: str, name: str, positive: float = 1.0) -> DataFrame:
    """(run_id, model, row_key, label, prediction, probability) — probability of the positive
    class for binary classifiers, NULL otherwise."""
    out = model.transform(data)
    if "probability" in out.columns:
        arr = vector_to_array("probability")
        prob = F.when(F.size(arr) == 2, arr[int(positive)])
    else:
        prob = F.lit(None).cast("double")
    return out.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("model"), "row_key",
                      F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"),
                      prob.cast("double").alias("probability"))


def score_of(preds: DataFrame, problem_type: str) -> float:
    """The CV score: accuracy (classification) or r2 (regression) — one aggregate."""
    if problem_type == "clasificacion":
        return preds.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    m = M.regression_metrics(preds, []).first()
    return m["r2"]


# --------------------------------------------------------------------------- M19, M20
@dataclass
class BenchmarkResult:
    run_id: str
    problem_type: str
    run_metrics: DataFrame          # (run_id, model, metric, value)
    predictions: DataFrame          # test-split predictions of every successful model
    models: dict = field(default_factory=dict)
    failures: list = field(default_factory=list)
    timings: dict = field(default_factory=dict)
    ranking: list = field(default_factory=list)
    data: DataFrame | None = None

    @property
    def best_model(self):
        return self.ranking[0][0] if self.ranking else None

    def release(self) -> None:
        """Drops the prepared data from memory."""
        if self.data is not None:
            self.data.unpersist()


def refusal(error: Exception) -> str | None:
    """What a model says that cannot be trained on its data; None for an error of the run itself (a lost task, memory,
    a programming error), which says nothing about the model."""
    msg = str(error)
    if not isinstance(error, (ValueError, ArithmeticError, IllegalArgumentException)) and "java.lang.IllegalArgumentException" not in msg:
        return None
    cause = msg[msg.find("Caused by"):][:300] if "Caused by" in msg else ""
    return f"{type(error).__name__}: {msg.splitlines()[0][:300] if msg else ''} {cause}".strip()


def train_one(name: str, est, data: DataFrame, run_id: str, problem_type: str, cv_folds: int = 5,
              seed: int = SEED, parallelism: int = PARALLELISM) -> tuple:
    """Fit on the training split, time it, predict the test split, compute the metrics and
    the k-fold CV mean/std on the training split (``parallelism`` folds at once; of the folds that
    have a score); that the data do not suit the model is returned, an error of the run is raised."""
    train = data.where(~F.col("is_test"))
    test = data.where(F.col("is_test"))
    try:
        t0 = time.time()
        model = est.fit(train)
        secs = time.time() - t0
        preds = predictions_of(model, test, run_id, name)
        if problem_type == "clasificacion":
            classes = [float(r[0]) for r in data.select("label").distinct().orderBy("label").limit(MAX_CLASSES + 1).collect()]
            if len(classes) > MAX_CLASSES:
                raise ValueError(f"more than {MAX_CLASSES} classes")
            if len(classes) > 2:                  # one-vs-rest, macro
                auc = M.multiclass_auc(class_scores(model, test, run_id, name, classes, train)) \
                       .select("run_id", "model", F.col("macro_auc").alias("auc"))
            else:
                auc = M.roc_auc(preds.where(F.col("probability").isNotNull()))
            rows = M.classification_metrics(preds).join(auc, ["run_id", "model"], "left")
        else:
            rows = M.regression_metrics(preds)
        metric_row = rows.first().asDict()
        metric_row.pop("run_id", None)
        metric_row.pop("model", None)
        if cv_folds and cv_folds > 1:
            from qualab.operators.crossval import assign_folds, cv_scores, mean_and_std
            folds = assign_folds(train, ["row_key"], cv_folds,
                                 label="label" if problem_type == "clasificacion" else None, seed=seed)
            folds = folds.persist(StorageLevel.MEMORY_AND_DISK)
            score = lambda tr, te: score_of(predictions_of(est.fit(tr), te, run_id, name), problem_type)
            try:
                cv = cv_scores(folds, score, cv_folds, parallelism=parallelism)
            finally:
                folds.unpersist()
            metric_row["cv_mean"], metric_row["cv_std"] = mean_and_std([s for _, s in cv])
        metric_row["train_seconds"] = secs
        return model, preds, metric_row, None
    except Exception as e:  # noqa: BLE001 - M19 records failures
        why = refusal(e)
        if why is None:
            raise
        return None, None, None, why


def benchmark(data: DataFrame, problem_type: str, run_id: str, models: Sequence[str] | None = None,
              cv_folds: int = 5, seed: int = SEED, parallelism: int = PARALLELISM) -> BenchmarkResult:
    """Train every model of the problem type on the persisted prepared data, sort by
    accuracy / r2 (descending), and return the long metrics, predictions and failures.
    ``parallelism`` models are trained at once, so ``train_seconds`` are those of shared executors.  The
    predictions are lazy and read ``data`` again: call ``release()`` once they have been used."""
    spark = data.sparkSession
    names = list(models or (CLASSIFICATION_MODELS if problem_type == "clasificacion" else REGRESSION_MODELS))
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    stats = data.agg(F.count_if(~F.col("is_test")).alias("n"), F.countDistinct("label").alias("k")).first()
    res = BenchmarkResult(run_id, problem_type, None, None, data=data)
    metric_rows, pred_frames = [], []

    def job(name: str):
        def run():
            try:
                est = make_estimator(name, problem_type, stats["n"], stats["k"], seed)
            except ValueError as e:
                return None, None, None, str(e)
            return train_one(name, est, data, run_id, problem_type, cv_folds, seed, parallelism=1)
        return run

    for name, (model, preds, row, err) in zip(names, run_jobs(spark, [job(n) for n in names], parallelism)):
        if err:
            res.failures.append((name, err))
            continue
        res.models[name] = model
        res.timings[name] = row.get("train_seconds")
        pred_frames.append(preds)
        for metric, value in row.items():
            metric_rows.append((run_id, name, metric, None if value is None else float(value)))
    main = "accuracy" if problem_type == "clasificacion" else "r2"
    res.ranking = sorted(((r[1], r[3]) for r in metric_rows if r[2] == main),
                         key=lambda t: (-(t[1] if t[1] is not None else float("-inf")), t[0]))
    res.run_metrics = spark.createDataFrame(metric_rows, "run_id string, model string, metric string, value double")
    if pred_frames:
        p = pred_frames[0]
        for q in pred_frames[1:]:
            p = p.unionByName(q)
        res.predictions = p
    return res


# --------------------------------------------------------------------------- M21
def save_models(result: BenchmarkResult, root: str) -> DataFrame:
    """Write every fitted model with Spark ML persistence; returns (run_id, model, path, kind), without a path and
    a kind for the models that failed."""
    rows = []
    for name, model in result.models.items():
        path = f"{root.rstrip('/')}/{result.run_id}/{name}"
        model.write().overwrite().save(path)
        rows.append((result.run_id, name, path, type(model).__name__))
    rows += [(result.run_id, name, None, None) for name, _ in result.failures]
    spark = result.run_metrics.sparkSession
    return spark.createDataFrame(rows, "run_id string, model string, path string, kind string")


def load_model(path: str, kind: str):
    """Load a model written by :func:`save_models` by its class name; one that failed cannot be loaded."""
    if path is None:
        raise ValueError("the model has no artefact")
    import pyspark.ml.classification as C
    import pyspark.ml.regression as R
    from qualab.operators import models_custom as MC
    from qualab.operators import kernel as K
    from qualab.operators import trees as TR
    for mod in (C, R, MC, TR, K):
        cls = getattr(mod, kind, None)
        if cls is not None:
            return cls.load(path)
    raise ValueError(f"unknown model kind {kind}")
