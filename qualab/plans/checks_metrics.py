"""Checked queries for evaluation metrics (E1-E17, J2) over the synthetic prediction tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from qualab.operators import metrics as M
from qualab.plans.fixtures import table
from qualab.plans.registry import check

K = "run_id, model"


def sql_per_class(t: str) -> str:
    return f"""
cc AS (SELECT {K}, label, prediction, count(*) AS n FROM {t} GROUP BY {K}, label, prediction),
rw AS (SELECT {K}, label AS cls, n AS sup, 0 AS pred, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM cc
       UNION ALL SELECT {K}, prediction, 0, n, 0 FROM cc),
g AS (SELECT {K}, cls, sum(sup) AS support, sum(pred) AS predicted, sum(tp) AS tp FROM rw GROUP BY {K}, cls),
pc0 AS (SELECT *, CASE WHEN predicted <> 0 THEN CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) ELSE 0.0 END AS precision,
               CASE WHEN support <> 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) ELSE 0.0 END AS recall FROM g),
pc AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc0)"""


def sql_class_metrics(t: str) -> str:
    return f"""WITH {sql_per_class(t)}
SELECT {K}, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
       sum(support * precision) / CAST(sum(support) AS DOUBLE) AS precision,
       sum(support * recall) / CAST(sum(support) AS DOUBLE) AS recall,
       sum(support * f1) / CAST(sum(support) AS DOUBLE) AS f1
FROM pc GROUP BY {K}"""


CM = ["accuracy", "precision", "recall", "f1"]


@check("e1_classification_metrics_binary", fixtures=["pred_binary"], round_cols=CM, sql=sql_class_metrics("pred_binary"))
def e1b(spark, sf):
    return M.classification_metrics(table(spark, sf, "pred_binary"))


@check("e1_classification_metrics_multi", fixtures=["pred_multi"], round_cols=CM, sql=sql_class_metrics("pred_multi"))
def e1m(spark, sf):
    return M.classification_metrics(table(spark, sf, "pred_multi"))


def sql_auc(t: str, keys: str, y: str, s: str) -> str:
    """Trapezoid ROC area by the rank-sum identity over distinct scores."""
    return f"""
SELECT {keys}, CASE WHEN max(tp_all) > 0 AND max(tn_all) > 0 THEN
         sum(neg * (cum_pos - pos / 2.0)) / (CAST(max(tp_all) AS DOUBLE) * CAST(max(tn_all) AS DOUBLE)) END AS auc
FROM (SELECT {keys}, score, pos, neg,
             sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
             sum(pos) OVER (PARTITION BY {keys}) AS tp_all, sum(neg) OVER (PARTITION BY {keys}) AS tn_all
      FROM (SELECT {keys}, CAST({s} AS DOUBLE) AS score, count(*) FILTER (WHERE {y}) AS pos,
                   count(*) FILTER (WHERE NOT ({y})) AS neg FROM {t} GROUP BY {keys}, CAST({s} AS DOUBLE)) AS g) AS r
GROUP BY {keys}"""


@check("e2_classification_report_binary", fixtures=["pred_binary"], round_cols=CM + ["auc"], sql=f"""
WITH {sql_per_class('pred_binary')},
     a AS ({sql_auc('pred_binary', K, 'label = 1.0', 'probability')})
SELECT {K}, accuracy, precision, recall, f1, n_classes, a.auc FROM (
  SELECT {K}, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
         coalesce(max(precision) FILTER (WHERE cls = 1.0), 0.0) AS precision,
         coalesce(max(recall) FILTER (WHERE cls = 1.0), 0.0) AS recall,
         coalesce(max(f1) FILTER (WHERE cls = 1.0), 0.0) AS f1, count(*) FILTER (WHERE support > 0) AS n_classes
  FROM pc GROUP BY {K}) AS m LEFT JOIN a USING (run_id, model)""")
def e2b(spark, sf):
    return M.classification_report(table(spark, sf, "pred_binary"))


@check("e2_classification_report_multi", fixtures=["pred_multi", "multi_scores"], round_cols=CM + ["auc"], sql=f"""
WITH {sql_per_class('pred_multi')},
     pa AS ({sql_auc('multi_scores', 'run_id, model, class', 'label = class', 'score')}),
     a AS (SELECT {K}, avg(auc) AS auc FROM pa GROUP BY {K})
SELECT {K}, accuracy, precision, recall, f1, n_classes, a.auc FROM (
  SELECT {K}, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(precision) AS precision,
         avg(recall) AS recall, avg(f1) AS f1, count(*) FILTER (WHERE support > 0) AS n_classes
  FROM pc GROUP BY {K}) AS m LEFT JOIN a USING (run_id, model)""")
def e2m(spark, sf):
    return M.classification_report(table(spark, sf, "pred_multi"), score=None,
                                   class_scores=table(spark, sf, "multi_scores"))


RM = ["r2", "mse", "rmse", "mae"]
SQL_REG = f"""
SELECT {K}, CASE WHEN var_pop(label) * count(*) > 0 THEN 1.0 - sum((label - prediction) * (label - prediction))
                 / (var_pop(label) * count(*)) END AS r2,
       avg((label - prediction) * (label - prediction)) AS mse,
       sqrt(avg((label - prediction) * (label - prediction))) AS rmse, avg(abs(label - prediction)) AS mae
FROM pred_reg GROUP BY {K}"""


@check("e3_regression_metrics", fixtures=["pred_reg"], round_cols=RM, sql=SQL_REG)
def e3(spark, sf):
    return M.regression_metrics(table(spark, sf, "pred_reg"))


@check("e3_regression_table", fixtures=["pred_reg"], round_cols=["r_noise", "r_shift"], sql=f"""
WITH m AS ({SQL_REG}),
     l AS (SELECT run_id, model, 'r2' AS metric, round(r2, 4) AS value FROM m
           UNION ALL SELECT run_id, model, 'mse', round(mse, 4) FROM m
           UNION ALL SELECT run_id, model, 'rmse', round(rmse, 4) FROM m
           UNION ALL SELECT run_id, model, 'mae', round(mae, 4) FROM m)
SELECT run_id, metric, max(value) FILTER (WHERE model = 'r_noise') AS r_noise,
       max(value) FILTER (WHERE model = 'r_shift') AS r_shift FROM l GROUP BY run_id, metric""")
def e3t(spark, sf):
    return M.regression_table(table(spark, sf, "pred_reg"))


SQL_CM_DENSE = f"""
cc AS (SELECT {K}, label, prediction, count(*) AS n FROM pred_multi GROUP BY {K}, label, prediction),
cls AS (SELECT DISTINCT {K}, label AS c FROM cc UNION SELECT DISTINCT {K}, prediction FROM cc),
dense AS (SELECT a.run_id, a.model, a.c AS label, b.c AS prediction, coalesce(cc.n, 0) AS n
          FROM cls a JOIN cls b ON a.run_id = b.run_id AND a.model = b.model
          LEFT JOIN cc ON cc.run_id = a.run_id AND cc.model = a.model AND cc.label = a.c AND cc.prediction = b.c)"""


@check("e4_confusion_matrix", fixtures=["pred_multi"], round_cols=["value"], sql=f"""
WITH {SQL_CM_DENSE} SELECT {K}, label, prediction, CAST(n AS DOUBLE) AS value FROM dense""")
def e4(spark, sf):
    return M.confusion_matrix(table(spark, sf, "pred_multi"))


@check("e4_confusion_matrix_true", fixtures=["pred_multi"], round_cols=["value"], sql=f"""
WITH {SQL_CM_DENSE}
SELECT {K}, label, prediction, CASE WHEN sum(n) OVER (PARTITION BY {K}, label) <> 0
       THEN CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY {K}, label) AS DOUBLE) ELSE 0.0 END AS value FROM dense""")
def e4t(spark, sf):
    return M.confusion_matrix(table(spark, sf, "pred_multi"), normalize="true")


SQL_RANKED = f"""
g AS (SELECT {K}, probability AS score, count(*) FILTER (WHERE label = 1.0) AS pos,
             count(*) FILTER (WHERE label <> 1.0) AS neg FROM pred_binary GROUP BY {K}, probability),
r AS (SELECT *, sum(pos) OVER (PARTITION BY {K} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
             sum(neg) OVER (PARTITION BY {K} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
             sum(pos) OVER (PARTITION BY {K}) AS tot_pos, sum(neg) OVER (PARTITION BY {K}) AS tot_neg FROM g)"""


@check("e5_roc_auc", fixtures=["pred_binary"], round_cols=["auc"],
       sql=sql_auc("pred_binary", K, "label = 1.0", "probability"))
def e5(spark, sf):
    return M.roc_auc(table(spark, sf, "pred_binary"))


@check("e5_e8_roc_points", fixtures=["pred_binary"], round_cols=["threshold", "fpr", "tpr"], sql=f"""
WITH {SQL_RANKED}
SELECT {K}, score AS threshold, CAST(cum_neg AS DOUBLE) / CAST(tot_neg AS DOUBLE) AS fpr,
       CAST(cum_pos AS DOUBLE) / CAST(tot_pos AS DOUBLE) AS tpr FROM r
UNION ALL SELECT DISTINCT {K}, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM r""")
def e5p(spark, sf):
    return M.roc_points(table(spark, sf, "pred_binary"))


@check("e6_multiclass_auc", fixtures=["multi_scores"], round_cols=["macro_auc"], sql=f"""
SELECT {K}, avg(auc) AS macro_auc FROM ({sql_auc('multi_scores', 'run_id, model, class', 'label = class', 'score')}) AS a
GROUP BY {K}""")
def e6(spark, sf):
    return M.multiclass_auc(table(spark, sf, "multi_scores")).select("run_id", "model", "macro_auc")


@check("e6_multiclass_roc_points", fixtures=["multi_scores"], round_cols=["threshold", "fpr", "tpr"], sql="""
WITH g AS (SELECT run_id, model, class, score, count(*) FILTER (WHERE label = class) AS pos,
                  count(*) FILTER (WHERE label <> class) AS neg FROM multi_scores GROUP BY run_id, model, class, score),
     r AS (SELECT *, sum(pos) OVER (PARTITION BY run_id, model, class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
                  sum(neg) OVER (PARTITION BY run_id, model, class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
                  sum(pos) OVER (PARTITION BY run_id, model, class) AS tp, sum(neg) OVER (PARTITION BY run_id, model, class) AS tn FROM g)
SELECT run_id, model, class, score AS threshold, CAST(cn AS DOUBLE) / CAST(tn AS DOUBLE) AS fpr,
       CAST(cp AS DOUBLE) / CAST(tp AS DOUBLE) AS tpr FROM r
UNION ALL SELECT DISTINCT run_id, model, class, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM r""")
def e6p(spark, sf):
    return M.multiclass_roc_points(table(spark, sf, "multi_scores"))


@check("e7_pr_points", fixtures=["pred_binary"], round_cols=["threshold", "precision", "recall"], sql=f"""
WITH {SQL_RANKED}
SELECT {K}, score AS threshold, CAST(cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE) AS precision,
       CAST(cum_pos AS DOUBLE) / CAST(tot_pos AS DOUBLE) AS recall FROM r WHERE cum_pos - pos < tot_pos
UNION ALL SELECT DISTINCT {K}, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM r""")
def e7p(spark, sf):
    return M.pr_points(table(spark, sf, "pred_binary"))


@check("e7_pr_area", fixtures=["pred_binary"], round_cols=["pr_area"], sql=f"""
WITH {SQL_RANKED},
     pts AS (SELECT {K}, score, CAST(cum_pos AS DOUBLE) / CAST(tot_pos AS DOUBLE) AS rc,
                    CAST(cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE) AS pr FROM r WHERE cum_pos - pos < tot_pos),
     seq AS (SELECT *, lag(rc, 1, 0.0) OVER (PARTITION BY {K} ORDER BY score DESC) AS rc0,
                    lag(pr, 1, 1.0) OVER (PARTITION BY {K} ORDER BY score DESC) AS pr0 FROM pts)
SELECT {K}, sum((rc - rc0) * (pr + pr0) / 2.0) AS pr_area FROM seq GROUP BY {K}""")
def e7a(spark, sf):
    return M.pr_area(table(spark, sf, "pred_binary"))


@check("e9_residuals", fixtures=["pred_reg"], round_cols=["label", "prediction", "residual"], sql=f"""
SELECT {K}, row_key, label, prediction, label - prediction AS residual FROM pred_reg""")
def e9(spark, sf):
    return M.residuals(table(spark, sf, "pred_reg"))


@check("e10_qq_ranks", fixtures=["pred_reg"], round_cols=["p", "sample"], sql=f"""
SELECT {K}, i AS rank, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
                            ELSE (i - 0.3175) / (n + 0.365) END AS p, e AS sample
FROM (SELECT {K}, label - prediction AS e, row_number() OVER (PARTITION BY {K} ORDER BY label - prediction) AS i,
             CAST(count(*) OVER (PARTITION BY {K}) AS DOUBLE) AS n FROM pred_reg WHERE label - prediction IS NOT NULL) AS r""")
def e10r(spark, sf):
    return M.qq_points(M.residuals(table(spark, sf, "pred_reg"))).select(*M.KEYS, "rank", "p", "sample")


@check("e10_qq_points")
def e10(spark, sf):
    return M.qq_points(M.residuals(table(spark, sf, "pred_reg")))


@check("e11_j2_prediction_pairs", fixtures=["pred_reg"], round_cols=["label", "r_noise", "r_shift"], sql="""
SELECT run_id, row_key, label, max(prediction) FILTER (WHERE model = 'r_noise') AS r_noise,
       max(prediction) FILTER (WHERE model = 'r_shift') AS r_shift FROM pred_reg GROUP BY run_id, row_key, label""")
def e11(spark, sf):
    return M.prediction_pairs(table(spark, sf, "pred_reg"), ["r_noise", "r_shift"])


@check("e11_identity_range", fixtures=["pred_reg"], round_cols=["lo", "hi"], sql=f"""
SELECT {K}, least(min(label), min(prediction)) AS lo, greatest(max(label), max(prediction)) AS hi FROM pred_reg GROUP BY {K}""")
def e11r(spark, sf):
    return M.identity_range(table(spark, sf, "pred_reg"))


SQL_SERIES = f"""
v AS (SELECT {K}, 'label' AS series, label AS value FROM pred_reg UNION ALL SELECT {K}, 'prediction', prediction FROM pred_reg)"""


@check("e12_distributions", fixtures=["pred_reg"], round_cols=["lower", "upper"], sql=f"""
WITH {SQL_SERIES}, b AS (SELECT {K}, series, min(value) AS lo, max(value) AS hi FROM v GROUP BY {K}, series),
c AS (SELECT {K}, series, CAST(least(floor((value - lo) * (CAST(30 AS DOUBLE) / (hi - lo))), 29) AS BIGINT) AS bin, count(*) AS cnt
      FROM v JOIN b USING (run_id, model, series) GROUP BY ALL)
SELECT {K}, series, CAST(g.range AS INTEGER) AS bin, lo + g.range * ((hi - lo) / CAST(30 AS DOUBLE)) AS lower,
       lo + (g.range + 1) * ((hi - lo) / CAST(30 AS DOUBLE)) AS upper, coalesce(cnt, 0) AS count
FROM b CROSS JOIN range(30) AS g LEFT JOIN (SELECT {K}, series, bin AS range, cnt FROM c) AS c USING (run_id, model, series, range)""")
def e12(spark, sf):
    return M.distribution_histograms(table(spark, sf, "pred_reg"))


@check("e12_densities", fixtures=["pred_reg"], round_cols=["x", "mass"], sql=f"""
WITH {SQL_SERIES},
p AS (SELECT {K}, series, count(*) AS n, stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2) AS bw, min(value) AS mn, max(value) AS mx
      FROM v GROUP BY {K}, series),
g AS (SELECT *, mn - 3 * bw AS g0, (mx - mn + 6 * bw) / CAST(199 AS DOUBLE) AS step FROM p),
w AS (SELECT {K}, series, value, count(*) AS w FROM v GROUP BY ALL)
SELECT {K}, series, CAST(i.range AS INTEGER) AS i, g0 + i.range * step AS x,
       step * sum(w * exp(-0.5 * ((g0 + i.range * step - value) / bw) * ((g0 + i.range * step - value) / bw))) / (n * bw * sqrt(2 * pi())) AS mass
FROM w JOIN g USING (run_id, model, series), range(200) AS i GROUP BY {K}, series, i.range, g0, step, n, bw""")
def e12d(spark, sf):
    """The densities as mass per step of the grid, so that six decimals tell them apart; the oracle sums all kernels."""
    out = M.distribution_densities(table(spark, sf, "pred_reg"))
    step = F.max("x").over(Window.partitionBy("run_id", "model", "series")) - F.min("x").over(Window.partitionBy("run_id", "model", "series"))
    return out.select("run_id", "model", "series", "i", "x", (F.col("density") * step / 199.0).alias("mass"))


@check("e13_confusion_summary", fixtures=["pred_multi"], round_cols=["accuracy"], sql=f"""
WITH {sql_per_class('pred_multi')}
SELECT {K}, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
       arg_min(cls, struct_pack(m := -precision, c := cls)) AS best_precision_class,
       arg_min(cls, struct_pack(m := precision, c := cls)) AS worst_precision_class,
       arg_min(cls, struct_pack(m := -recall, c := cls)) AS best_recall_class,
       arg_min(cls, struct_pack(m := recall, c := cls)) AS worst_recall_class
FROM pc GROUP BY {K}""")
def e13(spark, sf):
    return M.confusion_summary(table(spark, sf, "pred_multi"))


@check("e13_top_confusions", fixtures=["pred_multi"], round_cols=["value"], sql=f"""
WITH {SQL_CM_DENSE}
SELECT * FROM (SELECT {K}, label, prediction, CAST(n AS DOUBLE) AS value,
                      row_number() OVER (PARTITION BY {K} ORDER BY n DESC, label, prediction) AS rank
               FROM dense WHERE label <> prediction) AS x WHERE rank <= 3""")
def e13t(spark, sf):
    return M.top_confusions(table(spark, sf, "pred_multi"))


@check("e14_roc_report", fixtures=["pred_binary"], round_cols=["auc"], sql=f"""
SELECT {K}, auc, CASE WHEN auc >= 0.9 THEN 'excelente' WHEN auc >= 0.8 THEN 'bueno' WHEN auc >= 0.7 THEN 'aceptable'
                      WHEN auc >= 0.6 THEN 'debil' ELSE 'deficiente' END AS grade,
       CASE WHEN auc < 0.7 THEN 'improve_features_or_algorithm' WHEN auc < 0.8 THEN 'tune_or_ensemble'
            ELSE 'check_overfitting' END AS advice
FROM ({sql_auc('pred_binary', K, 'label = 1.0', 'probability')}) AS a""")
def e14(spark, sf):
    return M.roc_report(table(spark, sf, "pred_binary"))


@check("e15_residual_diagnosis", fixtures=["pred_reg"],
       round_cols=["mean", "median", "std", "min", "max", "normal_p", "variance_ratio"], sql=f"""
WITH e AS (SELECT {K}, label - prediction AS e FROM pred_reg),
     mo AS (SELECT {K}, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS std, min(e) AS min, max(e) AS max,
                   median(e) AS median FROM e GROUP BY {K}),
     cm AS (SELECT e.run_id, e.model, avg(power(e.e - mo.mean, 2)) AS m2, avg(power(e.e - mo.mean, 3)) AS m3,
                   avg(power(e.e - mo.mean, 4)) AS m4 FROM e JOIN mo USING (run_id, model) GROUP BY e.run_id, e.model),
     rk AS (SELECT {K}, e, row_number() OVER (PARTITION BY {K} ORDER BY e) - 1 AS j,
                   count(*) OVER (PARTITION BY {K}) AS n FROM e),
     sl AS (SELECT {K}, floor(5 * j / n) AS s0, j, n, e FROM rk),
     sv AS (SELECT {K}, s, var_pop(e) AS v FROM (
              SELECT {K}, e, CASE WHEN j < floor(n * 1 / 5) THEN 0 WHEN j < floor(n * 2 / 5) THEN 1
                                  WHEN j < floor(n * 3 / 5) THEN 2 WHEN j < floor(n * 4 / 5) THEN 3 ELSE 4 END AS s
              FROM sl) AS q GROUP BY {K}, s),
     vr AS (SELECT {K}, CASE WHEN min(v) > 0 THEN max(v) / min(v) ELSE 'inf'::DOUBLE END AS variance_ratio FROM sv GROUP BY {K}),
     k AS (SELECT mo.*, CAST(mo.n AS DOUBLE) AS nd, cm.m3 / power(cm.m2, 1.5) AS b1, cm.m4 / (cm.m2 * cm.m2) AS b2
           FROM mo JOIN cm USING (run_id, model)),
     z AS (SELECT *, b1 * sqrt(((nd + 1) * (nd + 3)) / (6.0 * (nd - 2))) AS y0,
                  (3.0 * (nd * nd + 27 * nd - 70) * (nd + 1) * (nd + 3)) / ((nd - 2.0) * (nd + 5) * (nd + 7) * (nd + 9)) AS beta2,
                  3.0 * (nd - 1) / (nd + 1) AS ek,
                  24.0 * nd * (nd - 2) * (nd - 3) / ((nd + 1) * (nd + 1) * (nd + 3) * (nd + 5)) AS varb2,
                  6.0 * (nd * nd - 5 * nd + 2) / ((nd + 7) * (nd + 9)) * sqrt((6.0 * (nd + 3) * (nd + 5)) / (nd * (nd - 2) * (nd - 3))) AS sb1
           FROM k),
     z2 AS (SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2, (b2 - ek) / sqrt(varb2) AS x,
                   6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a FROM z),
     z3 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha,
                   CASE WHEN y0 = 0 THEN 1.0 ELSE y0 END AS y, 1 + x * sqrt(2 / (a - 4.0)) AS den FROM z2),
     z4 AS (SELECT *, delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS zz1,
                   ((1 - 2 / (9.0 * a)) - sign(den) * power((1 - 2.0 / a) / abs(den), 1 / 3.0)) / sqrt(2 / (9.0 * a)) AS zz2
            FROM z3),
     p AS (SELECT *, exp(-(zz1 * zz1 + zz2 * zz2) / 2) AS normal_p FROM z4)
SELECT p.run_id, p.model, n, mean, median, std, min, max,
       CASE WHEN abs(mean) < 0.1 * std THEN 'centered' WHEN mean > 0 THEN 'underestimates' ELSE 'overestimates' END AS bias,
       normal_p, normal_p > 0.05 AS normal, variance_ratio, variance_ratio >= 3.0 AS heteroscedastic,
       std > (max - min) / 4 AS wide_spread
FROM p JOIN vr USING (run_id, model)""")
def e15(spark, sf):
    return M.residual_diagnosis(table(spark, sf, "pred_reg"))


def _run_metrics(spark, sf):
    cls = M.classification_report(table(spark, sf, "pred_binary"))
    reg = M.regression_metrics(table(spark, sf, "pred_reg"))
    return M.run_metrics_long(cls, reg)


SQL_RUN_METRICS = f"""
WITH {sql_per_class('pred_binary')},
     a AS ({sql_auc('pred_binary', K, 'label = 1.0', 'probability')}),
     c AS (SELECT m.*, a.auc FROM (
             SELECT {K}, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy,
                    coalesce(max(precision) FILTER (WHERE cls = 1.0), 0.0) AS precision,
                    coalesce(max(recall) FILTER (WHERE cls = 1.0), 0.0) AS recall,
                    coalesce(max(f1) FILTER (WHERE cls = 1.0), 0.0) AS f1
             FROM pc GROUP BY {K}) AS m LEFT JOIN a USING (run_id, model)),
     r AS ({SQL_REG})
SELECT {K}, 'accuracy' AS metric, accuracy AS value FROM c UNION ALL SELECT {K}, 'precision', precision FROM c
UNION ALL SELECT {K}, 'recall', recall FROM c UNION ALL SELECT {K}, 'f1', f1 FROM c
UNION ALL SELECT {K}, 'auc', auc FROM c
UNION ALL SELECT {K}, 'r2', r2 FROM r UNION ALL SELECT {K}, 'mse', mse FROM r
UNION ALL SELECT {K}, 'rmse', rmse FROM r UNION ALL SELECT {K}, 'mae', mae FROM r"""


@check("e16_metric_table", fixtures=["pred_binary", "pred_reg"], round_cols=["value"], sql=f"""
SELECT {K}, metric, value, CAST(list_position(['r2', 'mae', 'mse', 'rmse', 'mape'], metric) AS INTEGER) AS display_order
FROM ({SQL_RUN_METRICS}) AS m WHERE metric IN ('r2', 'mae', 'mse', 'rmse', 'mape')""")
def e16(spark, sf):
    return M.metric_table(_run_metrics(spark, sf), "regresion")


@check("e17_normalized_scores", fixtures=["pred_binary", "pred_reg"], round_cols=["value", "normalized"], sql=f"""
SELECT {K}, metric, value, v / max(v) OVER (PARTITION BY run_id, metric) AS normalized
FROM (SELECT *, CASE WHEN metric IN ('accuracy', 'precision', 'recall', 'f1', 'r2', 'auc') THEN value
                     ELSE 1.0 / (value + 1e-10) END AS v FROM ({SQL_RUN_METRICS}) AS m) AS x""")
def e17(spark, sf):
    return M.normalized_scores(_run_metrics(spark, sf))
