"""Evaluation metrics over a long ``predictions`` table
(run_id, model, row_key, label, prediction, probability) — many runs × models at once.

Everything is an aggregation: the only full-size step is a map-side-combined group-by on
(keys, label, prediction) or (keys, score); curves and areas use distributed running
totals (:mod:`qualab.functions.ranks`) and closed forms that need no ``lag``, so no window
ever holds all the scores of one model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualab.functions.ranks import exact_quantiles_from_counts, running_totals, spread_join, value_counts

KEYS = ["run_id", "model"]

# AUC grade cut points / labels and residual-diagnosis thresholds.
AUC_GRADES = [(0.9, "excelente"), (0.8, "bueno"), (0.7, "aceptable"), (0.6, "debil")]
AUC_GRADE_FALLBACK = "deficiente"
BIAS_SHARE = 0.1
NORMAL_P = 0.05
HETERO_RATIO = 3.0
RESIDUAL_SLICES = 5


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _safe_div(a: Column, b: Column) -> Column:
    """a / b with 0 when b is 0 (scikit-learn's zero_division=0)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------- E4 core
def confusion_counts(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """(keys, label, prediction, n) — the only pass over the predictions (combined map-side)."""
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
             .agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """(keys, class, support, predicted, tp, fp, fn, precision, recall, f1) over the union of
    true and predicted classes."""
    cc = confusion_counts(df, keys, label, prediction)
    rows = cc.select(*keys, F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pred"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pred"),
                 F.lit(0).cast("bigint").alias("tp")))))
    g = rows.groupBy(*keys, "cls").agg(F.sum("sup").alias("support"), F.sum("pred").alias("predicted"),
                                       F.sum("tp").alias("tp"))
    p = _safe_div(_d("tp"), _d("predicted"))
    r = _safe_div(_d("tp"), _d("support"))
    return g.select(*keys, F.col("cls").alias("class"), "support", "predicted", "tp",
                    (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"),
                    p.alias("precision"), r.alias("recall"), _safe_div(2 * p * r, p + r).alias("f1"))


# --------------------------------------------------------------------------- E1, E2, E3
def classification_metrics(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (zero_division = 0)."""
    pc = per_class(df, keys, label, prediction)
    return pc.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("support") * F.col("precision")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("support") * F.col("recall")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1"))


def classification_report(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                          prediction: str = "prediction", score: str = "probability",
                          class_scores: DataFrame | None = None, positive: float = 1.0) -> DataFrame:
    """Accuracy; binary average (positive class ``positive``) for two classes, macro
    average above; AUC (binary from ``score``, multiclass one-vs-rest macro from
    ``class_scores``); number of classes."""
    pc = per_class(df, keys, label, prediction)
    k = F.count_if(F.col("support") > 0)
    agg = pc.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), k.alias("n_classes"),
        F.max(F.when(F.col("class") == positive, F.col("precision"))).alias("_bp"),
        F.max(F.when(F.col("class") == positive, F.col("recall"))).alias("_br"),
        F.max(F.when(F.col("class") == positive, F.col("f1"))).alias("_bf"),
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"))
    binary = F.col("n_classes") <= 2
    out = agg.select(*keys, "accuracy",
                     F.when(binary, F.coalesce("_bp", F.lit(0.0))).otherwise(F.col("_mp")).alias("precision"),
                     F.when(binary, F.coalesce("_br", F.lit(0.0))).otherwise(F.col("_mr")).alias("recall"),
                     F.when(binary, F.coalesce("_bf", F.lit(0.0))).otherwise(F.col("_mf")).alias("f1"),
                     "n_classes")
    if class_scores is not None:
        auc = multiclass_auc(class_scores, keys).select(*keys, F.col("macro_auc").alias("auc"))
    elif score is not None:
        auc = roc_auc(df.where(F.col(score).isNotNull()), keys, label, score, positive)
    else:
        auc = None
    if auc is None:
        return out.withColumn("auc", F.lit(None).cast("double"))
    return out.join(auc, list(keys), "left")


def regression_metrics(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """r2 = 1 − SSE/SST, mse, rmse, mae (one aggregate; SST from a stable variance)."""
    e = _d(label) - _d(prediction)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                              F.sum(e * e).alias("sse"), F.var_pop(_d(label)).alias("vy"))
    sst = F.col("vy") * F.col("n")
    r2 = F.when(sst > 0, F.lit(1.0) - F.col("sse") / sst)
    return g.select(*keys, r2.alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae")


def regression_table(df: DataFrame, keys: Sequence[str] = ("run_id",), decimals: int = 4) -> DataFrame:
    """E3 display: metric rows × one column per model, rounded (model names discovered by pivot,
    bounded by ``spark.sql.pivotMaxValues``)."""
    m = regression_metrics(df, [*keys, "model"])
    long = m.select(*keys, "model", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.round(n, decimals).alias("value"))
                                                      for n in ("r2", "mse", "rmse", "mae")])))
    return long.groupBy(*keys, "metric").pivot("model").agg(F.first("value"))


# --------------------------------------------------------------------------- E4, E13
def confusion_matrix(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                     prediction: str = "prediction", normalize: str | None = None) -> DataFrame:
    """Dense (keys, label, prediction, value) over the union of classes; ``normalize`` =
    None | 'true' | 'pred' | 'all' (a 0/0 row becomes 0)."""
    cc = confusion_counts(df, keys, label, prediction)
    classes = cc.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.concat(
        F.collect_set("label"), F.collect_set("prediction")))).alias("cls"))
    grid = classes.select(*keys, F.explode("cls").alias("label"), "cls") \
                  .select(*keys, "label", F.explode("cls").alias("prediction"))
    dense = grid.join(cc, [*keys, "label", "prediction"], "left").select(
        *keys, "label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))
    if normalize is None:
        return dense.select(*keys, "label", "prediction", _d("n").alias("value"))
    part = {"true": [*keys, "label"], "pred": [*keys, "prediction"], "all": list(keys)}[normalize]
    total = F.sum("n").over(Window.partitionBy(*part))
    return dense.select(*keys, "label", "prediction", _safe_div(_d("n"), total.cast("double")).alias("value"))


def confusion_summary(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """Accuracy, best/worst class by precision and by recall (ties: first class)."""
    pc = per_class(df, keys, label, prediction)

    def best(metric: str, worst: bool) -> Column:
        s = F.struct((F.col(metric) if worst else -F.col(metric)).alias("m"), F.col("class").alias("c"))
        return F.min(s)["c"]
    return pc.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        best("precision", False).alias("best_precision_class"), best("precision", True).alias("worst_precision_class"),
        best("recall", False).alias("best_recall_class"), best("recall", True).alias("worst_recall_class"))


def top_confusions(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                   prediction: str = "prediction", k: int = 3) -> DataFrame:
    """The ``k`` largest off-diagonal cells per model (ties: true class, then predicted)."""
    cm = confusion_matrix(df, keys, label, prediction).where(F.col("label") != F.col("prediction"))
    w = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "label", "prediction")
    return cm.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --------------------------------------------------------------------------- E5-E8, E14
def _score_groups(df: DataFrame, keys: Sequence[str], label: str, score: str, positive: float) -> DataFrame:
    y = F.col(label) == F.lit(positive)
    return df.groupBy(*keys, _d(score).alias("score")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))


def _ranked_scores(df: DataFrame, keys: Sequence[str], label: str, score: str, positive: float) -> DataFrame:
    g = _score_groups(df, keys, label, score, positive)
    return running_totals(g, keys, -F.col("score"), ["pos", "neg"])


def roc_points(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", score: str = "probability",
               positive: float = 1.0) -> DataFrame:
    """(keys, threshold, fpr, tpr) at every distinct score (descending) plus the origin
    (threshold NULL).  Collinear points are kept (the area is unchanged)."""
    r = _ranked_scores(df, keys, label, score, positive)
    pts = r.select(*keys, F.col("score").alias("threshold"),
                   _safe_div(_d("cum_neg"), _d("tot_neg")).alias("fpr"),
                   _safe_div(_d("cum_pos"), _d("tot_pos")).alias("tpr"))
    origin = r.groupBy(*keys).agg(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                                  F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def roc_auc(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", score: str = "probability",
            positive: float = 1.0) -> DataFrame:
    """E5: trapezoid area under the ROC curve = Σ neg·(TP_before + pos/2) / (P·N) — the
    Mann-Whitney form, no ordered window needed.  NULL when a class is absent."""
    r = _ranked_scores(df, keys, label, score, positive)
    area = F.sum(_d("neg") * (_d("cum_pos") - _d("pos") / 2.0))
    return r.groupBy(*keys).agg(area.alias("_a"), F.first("tot_pos").alias("_p"), F.first("tot_neg").alias("_n")) \
            .select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                  F.col("_a") / (_d("_p") * _d("_n"))).alias("auc"))


def multiclass_auc(class_scores: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                   cls: str = "class", score: str = "score") -> DataFrame:
    """One-vs-rest AUC per class and their unweighted mean.
    ``class_scores`` is long: (keys, row_key, label, class, score)."""
    ovr = class_scores.withColumn("_y", (F.col(label) == F.col(cls)).cast("double"))
    per = roc_auc(ovr, [*keys, cls], "_y", score, 1.0)
    return per.groupBy(*keys).agg(F.avg("auc").alias("macro_auc"),
                                  F.sort_array(F.collect_list(F.struct(F.col(cls).alias("class"), "auc"))).alias("per_class"))


def multiclass_roc_points(class_scores: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                          cls: str = "class", score: str = "score") -> DataFrame:
    """E6 points: ROC curve per (keys, class)."""
    ovr = class_scores.withColumn("_y", (F.col(label) == F.col(cls)).cast("double"))
    return roc_points(ovr, [*keys, cls], "_y", score, 1.0)


def pr_points(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", score: str = "probability",
              positive: float = 1.0) -> DataFrame:
    """(keys, threshold, precision, recall) from the highest score down to the first
    threshold reaching full recall, plus the closing point (recall 0, precision 1)."""
    r = _ranked_scores(df, keys, label, score, positive)
    keep = r.where(F.col("cum_pos") - F.col("pos") < F.col("tot_pos"))
    pts = keep.select(*keys, F.col("score").alias("threshold"),
                      _safe_div(_d("cum_pos"), _d("cum_pos") + _d("cum_neg")).alias("precision"),
                      _safe_div(_d("cum_pos"), _d("tot_pos")).alias("recall"))
    close = r.groupBy(*keys).agg(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                                 F.lit(0.0).alias("recall"))
    return pts.unionByName(close)


def pr_area(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", score: str = "probability",
            positive: float = 1.0) -> DataFrame:
    """Trapezoid area under the precision-recall points (not average precision).  The
    previous point of each threshold group is its own cumulative counts minus the group."""
    r = _ranked_scores(df, keys, label, score, positive)
    keep = r.where(F.col("cum_pos") - F.col("pos") < F.col("tot_pos"))
    tp0, fp0 = _d("cum_pos") - _d("pos"), _d("cum_neg") - _d("neg")
    p1 = _safe_div(_d("cum_pos"), _d("cum_pos") + _d("cum_neg"))
    p0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    dr = _safe_div(_d("pos"), _d("tot_pos"))
    return keep.groupBy(*keys).agg(F.sum(dr * (p1 + p0) / 2.0).alias("pr_area"))


def auc_grade(auc: Column) -> tuple[Column, Column]:
    """(grade, advice) for an AUC value."""
    g = None
    for cut, name in AUC_GRADES:
        g = F.when(auc >= cut, F.lit(name)) if g is None else g.when(auc >= cut, F.lit(name))
    g = g.otherwise(F.lit(AUC_GRADE_FALLBACK))
    advice = F.when(auc < 0.7, F.lit("improve_features_or_algorithm")).when(auc < 0.8, F.lit("tune_or_ensemble")) \
              .otherwise(F.lit("check_overfitting"))
    return g, advice


def roc_report(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", score: str = "probability") -> DataFrame:
    """E14 over E5: (keys, auc, grade, advice)."""
    a = roc_auc(df, keys, label, score)
    g, adv = auc_grade(F.col("auc"))
    return a.select(*keys, "auc", g.alias("grade"), adv.alias("advice"))


# --------------------------------------------------------------------------- E9-E12, E15
def residuals(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", prediction: str = "prediction",
              row_key: str = "row_key") -> DataFrame:
    """(keys, row_key, label, prediction, residual = label − prediction)."""
    return df.select(*keys, row_key, _d(label).alias("label"), _d(prediction).alias("prediction"),
                     (_d(label) - _d(prediction)).alias("residual"))


def prediction_pairs(df: DataFrame, models: Sequence[str] | None = None, keys: Sequence[str] = ("run_id",),
                     row_key: str = "row_key") -> DataFrame:
    """One row per (row_key, label) with a prediction column per model."""
    g = df.groupBy(*keys, row_key, _d("label").alias("label"))
    p = g.pivot("model", list(models)) if models is not None else g.pivot("model")
    return p.agg(F.first(_d("prediction")))


def identity_range(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Min and max over labels and predictions (the identity line's extent)."""
    return df.groupBy(*keys).agg(F.least(F.min(_d("label")), F.min(_d("prediction"))).alias("lo"),
                                 F.greatest(F.max(_d("label")), F.max(_d("prediction"))).alias("hi"))


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile (Acklam's rational approximation, |error| < 1.2e-9)."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
    plow = 0.02425

    def poly(coef, x):
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out
    q = p - 0.5
    r = q * q
    central = poly(a, r) * q / (poly(b, r) * r + 1)
    ql = F.sqrt(-2 * F.log(p))
    low = poly(c, ql) / (poly(d, ql) * ql + 1)
    qh = F.sqrt(-2 * F.log(1 - p))
    high = -poly(c, qh) / (poly(d, qh) * qh + 1)
    return F.when(p < plow, low).when(p > 1 - plow, high).otherwise(central)


COPY_CHUNK = 10_000    # ranks of one value that are listed at a time


def qq_points(df: DataFrame, value: str = "residual", keys: Sequence[str] = KEYS) -> DataFrame:
    """Normal Q-Q pairs of every row (Filliben plotting positions of its rank among all n)
    and the least-squares line through them.  Equal values take neighbouring ranks."""
    counts = value_counts(df.select(*keys, _d(value).alias("v")), keys, "v")
    ranked = running_totals(counts, keys, F.col("v"), ["w"]).withColumn("_first", F.col("cum_w") - F.col("w") + 1)
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / COPY_CHUNK))).alias("_c")
    ranked = ranked.select(*keys, "v", "tot_w", "_first", "cum_w", chunk)
    lo = F.col("_first") + F.col("_c") * COPY_CHUNK
    rank = F.explode(F.sequence(lo, F.least(lo + COPY_CHUNK - 1, F.col("cum_w")))).alias("rank")
    n, i = F.col("tot_w").cast("double"), F.col("rank")
    last = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == n, last).when(i == 1, 1 - last).otherwise((i - 0.3175) / (n + 0.365))
    pts = ranked.select(*keys, "v", "tot_w", rank).select(*keys, "rank", p.alias("p"), inverse_normal(p).alias("theoretical"),
                                                          F.col("v").alias("sample"))
    fit = pts.groupBy(*keys).agg(F.covar_pop("theoretical", "sample").alias("_c"),
                                 F.var_pop("theoretical").alias("_v"), F.avg("theoretical").alias("_mx"),
                                 F.avg("sample").alias("_my"), F.corr("theoretical", "sample").alias("r"))
    fit = fit.select(*keys, (F.col("_c") / F.col("_v")).alias("slope"), "r", "_mx", "_my") \
             .select(*keys, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "r")
    return spread_join(pts, fit, keys, F.col("rank"))


def _slice_bounds(n: Column, i: int) -> tuple[Column, Column]:
    return F.floor(n * F.lit(i) / F.lit(RESIDUAL_SLICES)), F.floor(n * F.lit(i + 1) / F.lit(RESIDUAL_SLICES))


def residual_diagnosis(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label",
                       prediction: str = "prediction") -> DataFrame:
    """Mean, median, std (ddof 0), min, max; bias (centered / under / over-estimation);
    D'Agostino-Pearson normality p-value; variance ratio of the 5 contiguous slices of the
    sorted residuals (heteroscedastic ≥ 3); spread flag (std > range/4)."""
    e = (_d(label) - _d(prediction)).alias("e")
    res = df.select(*keys, e)
    mom = res.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"),
                                 F.stddev_pop("e").alias("std"), F.min("e").alias("min"), F.max("e").alias("max"),
                                 F.skewness("e").alias("g1"), F.kurtosis("e").alias("g2"))
    counts = value_counts(res, keys, "e")
    med = exact_quantiles_from_counts(counts, keys, "e", [0.5]).select(*keys, F.col("q").alias("median"))
    # slice variances: every distinct value covers 0-based ranks [cum − w, cum); split that
    # range over the fixed slice bounds arithmetically (no per-row expansion)
    ranked = running_totals(counts.withColumn("we", F.col("w") * F.col("e")), keys, F.col("e"), ["w", "we"])
    n = F.col("tot_w")
    parts = []
    for i in range(RESIDUAL_SLICES):
        lo, hi = _slice_bounds(n, i)
        cnt = F.greatest(F.lit(0), F.least(F.col("cum_w"), hi) - F.greatest(F.col("cum_w") - F.col("w"), lo))
        parts.append(F.struct(F.lit(i).alias("s"), cnt.alias("c")))
    # sums of squares about the group's mean: residuals far from zero lose no digits
    centred = ranked.withColumn("e", F.col("e") - F.col("tot_we") / F.col("tot_w"))
    sl = centred.select(*keys, "e", F.inline(F.array(*parts))).where(F.col("c") > 0)
    sv = sl.groupBy(*keys, "s").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("e")).alias("s1"),
                                     F.sum(F.col("c") * F.col("e") * F.col("e")).alias("s2"))
    var = F.greatest(F.col("s2") / F.col("c") - (F.col("s1") / F.col("c")) ** 2, F.lit(0.0))
    ratio = sv.select(*keys, var.alias("v")).groupBy(*keys).agg(
        F.when(F.min("v") > 0, F.max("v") / F.min("v")).otherwise(F.lit(float("inf"))).alias("variance_ratio"))
    out = mom.join(med, list(keys), "left").join(ratio, list(keys), "left")
    p = _dagostino_p(F.col("n").cast("double"), F.col("g1"), F.col("g2") + 3.0)
    bias = F.when(F.abs(F.col("mean")) < BIAS_SHARE * F.col("std"), F.lit("centered")) \
            .when(F.col("mean") > 0, F.lit("underestimates")).otherwise(F.lit("overestimates"))
    return out.select(*keys, "n", "mean", "median", "std", "min", "max", bias.alias("bias"),
                      p.alias("normal_p"), (p > NORMAL_P).alias("normal"), "variance_ratio",
                      (F.col("variance_ratio") >= HETERO_RATIO).alias("heteroscedastic"),
                      (F.col("std") > (F.col("max") - F.col("min")) / 4).alias("wide_spread"))


def _dagostino_p(n: Column, b1: Column, b2: Column) -> Column:
    """p-value of the D'Agostino-Pearson K² omnibus test from the biased skewness ``b1`` and
    the Pearson kurtosis ``b2`` (published closed forms; chi-square with 2 df)."""
    y = b1 * F.sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))
    beta2 = (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    z1 = delta * F.log(y / alpha + F.sqrt((y / alpha) ** 2 + 1))
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(denom) * F.pow((1 - 2.0 / a) / F.abs(denom), F.lit(1 / 3.0))
    z2 = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2)


# --------------------------------------------------------------------------- E16, E17
CLASSIFICATION_METRICS = ["accuracy", "precision", "recall", "f1", "auc"]
REGRESSION_METRICS = ["r2", "mae", "mse", "rmse", "mape"]
HIGHER_IS_BETTER = ["accuracy", "precision", "recall", "f1", "r2", "auc"]


def metric_table(run_metrics: DataFrame, problem_type: str) -> DataFrame:
    """The metrics of the problem type that are present, in display order."""
    names = CLASSIFICATION_METRICS if problem_type == "clasificacion" else REGRESSION_METRICS
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric"))
    return run_metrics.where(F.col("metric").isin(names)).withColumn("display_order", order.cast("int"))


def normalized_scores(run_metrics: DataFrame) -> DataFrame:
    """Per (run, metric) a 0-1 bar value: higher-better metrics as they are, error
    metrics as 1/(e + 1e-10); both divided by the best model's value."""
    v = F.when(F.col("metric").isin(HIGHER_IS_BETTER), F.col("value")).otherwise(1.0 / (F.col("value") + 1e-10))
    w = Window.partitionBy("run_id", "metric")
    return run_metrics.withColumn("_v", v).withColumn("normalized", F.col("_v") / F.max("_v").over(w)).drop("_v")


def run_metrics_long(classification: DataFrame | None = None, regression: DataFrame | None = None,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics of E1/E2/E3 frames as the long ``run_metrics`` table (keys, metric, value)."""
    parts = []
    for frame in (classification, regression):
        if frame is None:
            continue
        names = [c for c in frame.columns if c not in keys and c != "n_classes"]
        parts.append(frame.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), _d(n).alias("value"))
                                                            for n in names]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------- E12
def distributions(df: DataFrame, keys: Sequence[str] = KEYS, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(keys, series, value): real and predicted values as one long table."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("series"), _d(c).alias("value"))
                                               for s, c in (("label", label), ("prediction", prediction))])))


def distribution_histograms(df: DataFrame, keys: Sequence[str] = KEYS, bins: int = 30) -> DataFrame:
    """(keys, series, bin, lower, upper, count) of real and predicted values, every model at once."""
    from qualab.operators.profile import grouped_histogram
    return grouped_histogram(distributions(df, keys), "value", [*keys, "series"], bins)


def distribution_densities(df: DataFrame, keys: Sequence[str] = KEYS, gridsize: int = 200) -> DataFrame:
    """(keys, series, i, x, density) of real and predicted values, every model at once."""
    from qualab.operators.profile import density
    return density(distributions(df, keys), "value", gridsize, keys=[*keys, "series"])
