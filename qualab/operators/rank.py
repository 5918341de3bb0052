"""Model ranking, recommendation, readiness checks and report tables over the run store.

The rules work on the *whole* ``runs`` / ``run_metrics`` / fold-score tables (many runs ×
models), never on one result object; windows are partitioned by run, whose size is the
number of models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualab.operators.metrics import HIGHER_IS_BETTER

# Metric lists of the comparison tables and report thresholds.
COMPARE_METRICS = ["accuracy", "precision", "recall", "f1", "auc", "r2", "mse", "rmse", "mae"]
REPORT_NULL_HIGH = 20.0
REPORT_NULL_MODERATE = 5.0


def _criterion(problem_type: Column, criterion: str | None) -> Column:
    if criterion and criterion != "auto":
        return F.lit(criterion)
    return F.when(problem_type == "clasificacion", F.lit("accuracy")).otherwise(F.lit("r2"))


def recommend(runs: DataFrame, run_metrics: DataFrame, criterion: str | None = "auto") -> DataFrame:
    """Best model per run by ``criterion`` (auto: accuracy / r2).  Higher-better metrics
    rank descending, others ascending; a model without the metric counts as 0 (higher-better)
    or +inf.  Ties: model name ascending."""
    crit = runs.select("run_id", _criterion(F.col("problem_type"), criterion).alias("criterion"))
    models = run_metrics.select("run_id", "model").distinct().join(crit, "run_id")
    vals = run_metrics.select("run_id", "model", F.col("metric").alias("criterion"), "value")
    j = models.join(vals, ["run_id", "model", "criterion"], "left")
    higher = F.col("criterion").isin(HIGHER_IS_BETTER)
    v = F.coalesce(F.col("value"), F.when(higher, F.lit(0.0)).otherwise(F.lit(float("inf"))))
    score = F.when(higher, v).otherwise(-v)
    w = Window.partitionBy("run_id").orderBy(score.desc(), F.col("model"))
    return j.select("run_id", "model", "criterion", v.alias("value"), F.row_number().over(w).alias("rank")) \
            .where(F.col("rank") == 1).drop("rank")


def comparison_table(runs: DataFrame, run_metrics: DataFrame, criterion: str | None = "auto") -> DataFrame:
    """R2: one row per (run, model) with a column per metric, the recommended flag, and the
    rank by the criterion."""
    wide = run_metrics.groupBy("run_id", "model").pivot("metric", COMPARE_METRICS).agg(F.first("value"))
    best = recommend(runs, run_metrics, criterion).select("run_id", F.col("model").alias("_best"), "criterion")
    j = wide.join(best, "run_id")
    crit_val = F.coalesce(*[F.when(F.col("criterion") == m, F.col(m)) for m in COMPARE_METRICS])
    higher = F.col("criterion").isin(HIGHER_IS_BETTER)
    w = Window.partitionBy("run_id").orderBy(F.when(higher, -crit_val).otherwise(crit_val).asc_nulls_last(), "model")
    return j.select("run_id", "model", *COMPARE_METRICS, (F.col("model") == F.col("_best")).alias("recommended"),
                    "criterion", F.row_number().over(w).alias("position"))


def leaderboard(run_metrics: DataFrame, fold_scores: DataFrame | None = None, sort_metric: str = "accuracy",
                ascending: bool = False, decimals: int = 4) -> DataFrame:
    """Metrics rounded to ``decimals``, CV 'mean ± std' text (population std over folds),
    sorted on ``sort_metric``."""
    wide = run_metrics.groupBy("run_id", "model").pivot("metric", COMPARE_METRICS).agg(F.first("value"))
    out = wide.select("run_id", "model", *[F.round(m, decimals).alias(m) for m in COMPARE_METRICS])
    if fold_scores is not None:
        cv = fold_scores.where(F.col("split") == "test").groupBy("run_id", "model").agg(
            F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))
        cv = cv.select("run_id", "model", "cv_mean", "cv_std", F.concat(
            F.format_string(f"%.{decimals}f", "cv_mean"), F.lit(" ± "),
            F.format_string(f"%.{decimals}f", "cv_std")).alias("cv"))
        out = out.join(cv, ["run_id", "model"], "left")
    w = Window.partitionBy("run_id").orderBy(
        (F.col(sort_metric).asc_nulls_last() if ascending else F.col(sort_metric).desc_nulls_last()), "model")
    return out.withColumn("position", F.row_number().over(w))


def pick_model(runs: DataFrame, run_metrics: DataFrame, name: str | None = None) -> DataFrame:
    """Per run the named model when present, else the recommended one, else the first by name."""
    models = run_metrics.select("run_id", "model").distinct()
    best = recommend(runs, run_metrics).select("run_id", F.col("model").alias("_best"))
    j = models.join(best, "run_id", "left")
    pri = F.when(F.lit(name).isNotNull() & (F.col("model") == F.lit(name)), 0) \
           .when(F.col("model") == F.col("_best"), 1).otherwise(2)
    w = Window.partitionBy("run_id").orderBy(pri, "model")
    return j.select("run_id", "model", pri.alias("_p"), F.row_number().over(w).alias("_r")).where("_r = 1") \
            .select("run_id", "model", F.when(F.col("_p") == 0, "named").when(F.col("_p") == 1, "best")
                    .otherwise("first").alias("reason"))


# --------------------------------------------------------------------------- V12-V14
def results_ready(runs: DataFrame, run_metrics: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per run whether cross-validation can start: required fields, a test split
    (predictions) and at least one successful model; ``missing`` lists what is absent."""
    pc = predictions.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_test"))
    mc = run_metrics.groupBy("run_id").agg(F.countDistinct("model").alias("n_models"))
    j = runs.select("run_id", "problem_type", "target").join(pc, "run_id", "left").join(mc, "run_id", "left")
    checks = F.array(
        F.when(F.col("problem_type").isNull(), F.lit("problem_type")),
        F.when(F.col("target").isNull(), F.lit("target")),
        F.when(F.coalesce(F.col("n_test"), F.lit(0)) == 0, F.lit("test_split")),
        F.when(F.coalesce(F.col("n_models"), F.lit(0)) == 0, F.lit("successful_model")))
    missing = F.filter(checks, lambda x: x.isNotNull())
    return j.select("run_id", (F.size(missing) == 0).alias("ok"), missing.alias("missing"),
                    F.coalesce("n_test", F.lit(0)).alias("n_test"), F.coalesce("n_models", F.lit(0)).alias("n_models"))


def artefacts_available(artifacts: DataFrame) -> DataFrame:
    """Per run, models with a stored artefact out of all models (k / n)."""
    return artifacts.groupBy("run_id").agg(F.count("path").alias("available"), F.count(F.lit(1)).alias("models")) \
                    .select("run_id", "available", "models", (F.col("available") == F.col("models")).alias("complete"))


def evaluation_ready(runs: DataFrame, run_metrics: DataFrame, predictions: DataFrame,
                     artifacts: DataFrame | None = None) -> DataFrame:
    """Per (run, model): test data, artefact, probabilities (classification), metrics, and a
    known problem type."""
    p = predictions.groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("n_test"),
                                                   F.count("probability").alias("n_prob"))
    m = run_metrics.groupBy("run_id", "model").agg(F.count(F.lit(1)).alias("n_metrics"))
    j = p.join(m, ["run_id", "model"], "full").join(runs.select("run_id", "problem_type"), "run_id", "left")
    if artifacts is not None:
        j = j.join(artifacts.select("run_id", "model", "path"), ["run_id", "model"], "left")
    else:
        j = j.withColumn("path", F.lit(None).cast("string"))
    known = F.col("problem_type").isin("clasificacion", "regresion")
    probs = F.when(F.col("problem_type") == "clasificacion", F.coalesce(F.col("n_prob"), F.lit(0)) > 0).otherwise(F.lit(True))
    return j.select("run_id", "model", (F.coalesce("n_test", F.lit(0)) > 0).alias("has_test"),
                    F.col("path").isNotNull().alias("has_artefact"), probs.alias("has_probabilities"),
                    (F.coalesce("n_metrics", F.lit(0)) > 0).alias("has_metrics"), F.coalesce(known, F.lit(False)).alias("known_type"))


# --------------------------------------------------------------------------- O1-O5
def _kv(df: DataFrame, section: str, items: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.lit(section).alias("section"),
                     F.inline(F.array(*[F.struct(F.lit(k).alias("item"), v.cast("string").alias("value"))
                                        for k, v in items.items()])))


def report_quality(score: DataFrame, nulls: DataFrame, top: int = 10) -> DataFrame:
    """O1: seven headline metrics + grade, and the ``top`` columns with most nulls."""
    head = _kv(score, "quality", {
        "n_rows": F.col("n_rows"), "n_columns": F.col("n_columns"), "null_pct": F.format_string("%.2f", "null_pct"),
        "duplicate_rows": F.col("duplicate_rows"), "duplicate_pct": F.format_string("%.2f", "duplicate_pct"),
        "completeness": F.format_string("%.2f", "completeness"), "score": F.format_string("%.2f", "score"), "grade": F.col("grade")})
    topn = nulls.where(F.col("nulls") > 0).orderBy(F.col("pct").desc(), F.col("col_name")).limit(top) \
                .select(F.lit("quality_nulls").alias("section"), F.col("col_name").alias("item"),
                        F.format_string("%.2f", "pct").alias("value"))
    return head.unionByName(topn)


def report_models(runs: DataFrame, run_metrics: DataFrame, first_metrics: int = 5) -> DataFrame:
    """O2: per run the model table (first five comparison metrics present, best flagged) as
    (run_id, model, metric, value, best) rows; the main-metric bars are the rows whose metric
    is the run's criterion."""
    best = recommend(runs, run_metrics).select("run_id", F.col("model").alias("_best"), "criterion")
    order = F.array_position(F.array(*[F.lit(m) for m in COMPARE_METRICS]), F.col("metric"))
    present = run_metrics.where(F.col("metric").isin(COMPARE_METRICS)).withColumn("_o", order)
    firsts = present.groupBy("run_id").agg(F.slice(F.array_sort(F.collect_set("_o")), 1, first_metrics).alias("_keep"))
    j = present.join(firsts, "run_id").where(F.array_contains("_keep", F.col("_o"))).join(best, "run_id")
    return j.select("run_id", "model", "metric", "value", (F.col("model") == F.col("_best")).alias("best"),
                    (F.col("metric") == F.col("criterion")).alias("main_metric"))


def report_selection(runs: DataFrame, run_metrics: DataFrame, criterion: str | None = "auto") -> DataFrame:
    """O3: the selected model, the criterion and the model's metrics."""
    r = recommend(runs, run_metrics, criterion)
    m = run_metrics.join(r.select("run_id", "model"), ["run_id", "model"])
    head = r.select("run_id", F.lit("selection").alias("section"), F.inline(F.array(
        F.struct(F.lit("model").alias("item"), F.col("model").alias("value")),
        F.struct(F.lit("criterion").alias("item"), F.col("criterion").alias("value")),
        F.struct(F.lit("criterion_value").alias("item"), F.format_string("%.4f", "value").alias("value")))))
    return head.unionByName(m.select("run_id", F.lit("selection_metrics").alias("section"), F.col("metric").alias("item"),
                                     F.format_string("%.4f", "value").alias("value")))


def report_importances(importances: DataFrame, top: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Top-``top`` features by |importance| with their rank (ties: feature name)."""
    w = Window.partitionBy(*keys).orderBy(F.abs("importance").desc(), "feature") if keys else \
        Window.orderBy(F.abs("importance").desc(), "feature")
    return importances.select(*keys, "feature", "importance", F.row_number().over(w).alias("rank")) \
                      .where(F.col("rank") <= top)


def report_conclusions(score: DataFrame, runs: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """Conclusion rule rows: null level, one best-model line per run, the closing line."""
    lvl = F.when(F.col("null_pct") > REPORT_NULL_HIGH, "high_nulls").when(
        F.col("null_pct") > REPORT_NULL_MODERATE, "moderate_nulls").otherwise("ok_nulls")
    a = score.select(F.lit(None).cast("string").alias("run_id"), F.lit("conclusion").alias("section"),
                     lvl.alias("item"), F.format_string("%.2f", "null_pct").alias("value"))
    b = recommend(runs, run_metrics).select("run_id", F.lit("conclusion").alias("section"),
                                           F.lit("best_model").alias("item"),
                                           F.concat_ws(":", "model", "criterion", F.format_string("%.4f", "value")).alias("value"))
    c = score.select(F.lit(None).cast("string").alias("run_id"), F.lit("conclusion").alias("section"),
                     F.lit("closing").alias("item"), F.lit("review_before_production").alias("value"))
    return a.unionByName(b).unionByName(c)
