"""Checked queries for cross-validation (C1-C13); model training checks are added below."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualab.operators import crossval as C
from qualab.operators import rank as R
from qualab.plans import runs_fixture as RF
from qualab.plans.fixtures import table
from qualab.plans.registry import check

FX = RF.FIXTURES
H42 = "CAST(('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"


@check("c1_stratified_folds", sql=f"""
SELECT o_orderstatus, fold, count(*) AS n FROM (
  SELECT o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H42}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
  FROM orders) AS f GROUP BY o_orderstatus, fold""")
def c1s(spark, sf):
    f = C.assign_folds(table(spark, sf, "orders"), ["o_orderkey"], 5, label="o_orderstatus")
    return f.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@check("c1_hash_folds", sql=f"""
SELECT CAST(floor({H42} * 5) AS INTEGER) AS fold, count(*) AS n FROM orders GROUP BY 1""")
def c1h(spark, sf):
    return C.assign_folds(table(spark, sf, "orders"), ["o_orderkey"], 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


CV_ROUND = ["mean", "std", "min", "max", "variance", "median", "range"]
SQL_CV = """
SELECT run_id, model, mean, std, min, max, variance, median, n_folds, max - min AS range,
       CASE WHEN std < 0.02 THEN 'very_consistent' WHEN std < 0.05 THEN 'normal' ELSE 'inconsistent' END AS consistency
FROM (SELECT run_id, model, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max,
             var_pop(score) AS variance, median(score) AS median, count(*) AS n_folds
      FROM fold_scores WHERE split = 'test' GROUP BY run_id, model) AS s"""


@check("c2_c9_cv_summary", fixtures=FX, round_cols=CV_ROUND, sql=RF.with_run_tables(SQL_CV))
def c2(spark, sf):
    return C.cv_summary(RF.fold_scores(spark, sf))


@check("c10_cv_histogram", fixtures=FX, sql=RF.with_run_tables("""
SELECT f.run_id, f.model, CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((score - lo) / (hi - lo) * bins), bins - 1) END AS INTEGER) AS bin,
       count(*) AS count
FROM fold_scores AS f JOIN (SELECT run_id, model, min(score) AS lo, max(score) AS hi, least(count(*), 10) AS bins
                            FROM fold_scores WHERE split = 'test' GROUP BY run_id, model) AS s USING (run_id, model)
WHERE split = 'test' GROUP BY 1, 2, 3"""))
def c10(spark, sf):
    return C.cv_histogram(RF.fold_scores(spark, sf))


SQL_CURVE = """
SELECT *, train_mean + train_std AS train_hi, train_mean - train_std AS train_lo, val_mean + val_std AS val_hi,
       val_mean - val_std AS val_lo, train_mean - val_mean AS gap
FROM (SELECT run_id, model, size, avg(score) FILTER (WHERE split = 'train') AS train_mean,
             stddev_pop(score) FILTER (WHERE split = 'train') AS train_std,
             avg(score) FILTER (WHERE split = 'test') AS val_mean, stddev_pop(score) FILTER (WHERE split = 'test') AS val_std
      FROM curve_scores GROUP BY run_id, model, size) AS c"""
CURVE_ROUND = ["size", "train_mean", "train_std", "val_mean", "val_std", "train_hi", "train_lo", "val_hi", "val_lo", "gap"]


@check("c3_c12_curve_summary", fixtures=FX, round_cols=CURVE_ROUND, sql=RF.with_curve_tables(SQL_CURVE))
def c3(spark, sf):
    return C.curve_summary(RF.curve_scores(spark, sf))


SQL_GAPS = f"""
SELECT run_id, model, final_gap, max_gap, CASE WHEN final_gap > first_gap THEN 'creciente' ELSE 'decreciente' END AS gap_trend
FROM (SELECT run_id, model, arg_max(gap, size) AS final_gap, arg_min(gap, size) AS first_gap, max(gap) AS max_gap
      FROM ({SQL_CURVE}) AS c GROUP BY run_id, model) AS g"""


@check("c3_gap_summary", fixtures=FX, round_cols=["final_gap", "max_gap"], sql=RF.with_curve_tables(SQL_GAPS))
def c3g(spark, sf):
    return C.gap_summary(RF.curve_scores(spark, sf))


@check("c4_c6_c7_c8_advanced_diagnosis", fixtures=FX, round_cols=["cv_mean", "cv_std", "final_gap", "max_gap"],
       sql=RF.with_curve_tables(f"""
SELECT *, list_filter([CASE WHEN overfitting = 'posible' AND final_gap > 0.15 THEN 'overfit_severe' END,
                       CASE WHEN overfitting = 'posible' AND final_gap <= 0.15 THEN 'overfit_moderate' END,
                       CASE WHEN underfitting = 'posible' THEN 'underfit' END, CASE WHEN cv_std > 0.1 THEN 'unstable' END,
                       CASE WHEN overfitting = 'improbable' AND underfitting = 'improbable' AND cv_std < 0.05 THEN 'balanced' END],
                      lambda x: x IS NOT NULL) AS recommendations,
       CASE WHEN overfitting = 'posible' THEN 'overfitting' WHEN underfitting = 'posible' THEN 'underfitting'
            ELSE 'balanceado' END AS diagnosis_type
FROM (SELECT cv.run_id, cv.model, cv.mean AS cv_mean, cv.std AS cv_std, g.final_gap, g.max_gap, g.gap_trend,
             CASE WHEN g.final_gap > 0.1 OR g.max_gap > 0.15 THEN 'posible' WHEN g.final_gap < 0.03 THEN 'improbable'
                  ELSE 'normal' END AS overfitting,
             CASE WHEN cv.mean < CASE WHEN r.problem_type = 'clasificacion' THEN 0.7 ELSE 0.5 END THEN 'posible'
                  ELSE 'improbable' END AS underfitting,
             cv.std > 0.1 AS high_variance,
             CASE WHEN g.final_gap > 0.15 THEN 'severe' WHEN g.final_gap > 0.1 THEN 'moderate'
                  WHEN g.final_gap > 0.05 THEN 'normal' ELSE 'excellent' END AS gap_band
      FROM ({SQL_CV}) AS cv JOIN ({SQL_GAPS}) AS g USING (run_id, model) LEFT JOIN runs AS r ON r.run_id = cv.run_id) AS d"""))
def c4(spark, sf):
    return C.advanced_diagnosis(RF.fold_scores(spark, sf), RF.curve_scores(spark, sf), RF.runs(spark, sf))


@check("c5_c6_simple_diagnosis", fixtures=FX, round_cols=["cv_mean", "cv_std"], sql=RF.with_run_tables(f"""
SELECT * EXCLUDE (codes), CASE WHEN len(codes) = 0 THEN ['balanced'] ELSE codes END AS recommendations FROM (
  SELECT run_id, model, cv_mean, cv_std, overfitting, underfitting,
         list_filter([CASE WHEN overfitting = 'posible' THEN 'overfit' END, CASE WHEN underfitting = 'posible' THEN 'underfit' END,
                      CASE WHEN cv_std > 0.1 THEN 'unstable' END], lambda x: x IS NOT NULL) AS codes
  FROM (SELECT run_id, model, mean AS cv_mean, std AS cv_std,
               CASE WHEN std > 0.1 THEN 'posible' WHEN std < 0.03 THEN 'improbable' ELSE 'normal' END AS overfitting,
               CASE WHEN mean < 0.6 THEN 'posible' ELSE 'improbable' END AS underfitting FROM ({SQL_CV}) AS s) AS d) AS e"""))
def c5(spark, sf):
    return C.simple_diagnosis(RF.fold_scores(spark, sf))


@check("c13_model_bars", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables("""
SELECT run_id, model, metric, value FROM run_metrics
WHERE metric IN ('accuracy', 'precision', 'recall', 'f1', 'auc') AND value IS NOT NULL"""))
def c13(spark, sf):
    cmp = R.comparison_table(RF.runs(spark, sf), RF.run_metrics(spark, sf))
    return C.model_bars(cmp, ["accuracy", "precision", "recall", "f1", "auc"])


# =========================================================================== models
from pyspark.ml.feature import VectorAssembler  # noqa: E402
from pyspark.ml.functions import array_to_vector  # noqa: E402
from pyspark.ml.regression import LinearRegression  # noqa: E402
from pyspark.ml.classification import NaiveBayes  # noqa: E402

from qualab.operators import models as MO  # noqa: E402
from qualab.operators import models_custom as MC  # noqa: E402
from qualab.session import ensure_checkpoint_dir  # noqa: E402
import uuid  # noqa: E402


def _docs_data(spark, sf):
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    data, _ = MO.prepare_model_data(docs.drop("toxic"), "quality", "clasificacion", ["doc_id"])
    return data


def _reg_data(spark, sf):
    """Regression task over whole tables: document length from language, source and labels."""
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    data, _ = MO.prepare_model_data(docs, "n_chars", "regresion", ["doc_id"])
    return data


def _model_check(name: str, problem: str):
    def run(spark, sf):
        data = _docs_data(spark, sf) if problem == "clasificacion" else _reg_data(spark, sf)
        stats = data.agg(F.count_if(~F.col("is_test")).alias("n"), F.countDistinct("label").alias("k")).first()
        est = MO.make_estimator(name, problem, stats["n"], stats["k"])
        model = est.fit(data.where(~F.col("is_test")))
        return MO.predictions_of(model, data.where(F.col("is_test")), "run_check", name)
    return run


@check("m6_knn_exact_embeddings", sql="""
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS label,
                  CAST(('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 < 0.2 AS is_test
           FROM embeddings),
     nb AS (SELECT q.vec_id AS q, t.label AS nl,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x), CAST(t.vec_id AS VARCHAR)) AS r
            FROM s AS q JOIN s AS t ON q.is_test AND NOT t.is_test),
     votes AS (SELECT q, nl, count(*) AS v FROM nb WHERE r <= 5 GROUP BY q, nl)
SELECT CAST(q AS VARCHAR) AS row_key, label, prediction FROM (
  SELECT q, nl AS prediction, row_number() OVER (PARTITION BY q ORDER BY v DESC, nl) AS k FROM votes) AS b
JOIN s ON s.vec_id = b.q WHERE k = 1""")
def m6x(spark, sf):
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("row_key"),
                                                array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                                                F.col("label").cast("double").alias("label"), "vec_id")
    from qualab.functions.hashing import hash_unit
    emb = emb.withColumn("is_test", hash_unit(F.col("vec_id").cast("string")) < 0.2)
    model = MC.KNeighbors(k=5).fit(emb.where(~F.col("is_test")))
    return model.transform(emb.where(F.col("is_test"))).select("row_key", "label", "prediction")


@check("m17_knn_regressor_exact", sql="""
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS label,
                  CAST(('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 < 0.2 AS is_test
           FROM embeddings),
     nb AS (SELECT q.vec_id AS q, t.label AS nl,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x), CAST(t.vec_id AS VARCHAR)) AS r
            FROM s AS q JOIN s AS t ON q.is_test AND NOT t.is_test)
SELECT CAST(q AS VARCHAR) AS row_key, s.label, avg(nl) AS prediction FROM nb JOIN s ON s.vec_id = nb.q
WHERE r <= 5 GROUP BY q, s.label""", round_cols=["prediction"])
def m17x(spark, sf):
    from qualab.functions.hashing import hash_unit
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("row_key"),
                                                array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                                                F.col("label").cast("double").alias("label"), "vec_id")
    emb = emb.withColumn("is_test", hash_unit(F.col("vec_id").cast("string")) < 0.2)
    model = MC.KNeighbors(k=5, problem_type="regresion").fit(emb.where(~F.col("is_test")))
    return model.transform(emb.where(F.col("is_test"))).select("row_key", "label", "prediction")


@check("m9_linear_regression_coefficients", round_cols=["slope", "intercept"], sql="""
SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem""")
def m9x(spark, sf):
    li = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(table(spark, sf, "lineitem"))
    m = LinearRegression(solver="normal", standardization=False, labelCol="l_extendedprice").fit(li)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


SQL_ONE = """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v,
                  avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem),
     w AS (SELECT my, mx, {} AS slope FROM s)
SELECT slope, my - slope * mx AS intercept FROM w"""


def _one_predictor(name: str):
    def run(spark, sf):
        li = table(spark, sf, "lineitem").select(F.col("l_quantity"), F.col("l_extendedprice").alias("label"))
        li = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li)
        m = MO.make_estimator(name, "regresion", li.count()).fit(li)
        return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 3))], "slope double, intercept double")
    return run


# the minimum of the objective in closed form: soft threshold of the covariance over variance plus the l2 weight
for _name, _id, _slope in [("Ridge", "m10", "c / (v + 1 / n)"), ("Lasso", "m11", "sign(c) * greatest(abs(c) - 1, 0) / v"),
                           ("ElasticNet", "m12", "sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5)")]:
    check(f"{_id}_{_name.lower()}_coefficients", sql=f"SELECT round(slope, 4) AS slope, round(intercept, 3) AS intercept FROM ({SQL_ONE.format(_slope)}) AS q",
          round_cols=["slope", "intercept"])(_one_predictor(_name))


_RIDGE2 = """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, var_pop(l_quantity) AS a, var_pop(l_tax) AS d, covar_pop(l_quantity, l_tax) AS b,
                  covar_pop(l_extendedprice, l_quantity) AS p, covar_pop(l_extendedprice, l_tax) AS q FROM lineitem)
SELECT round(((d + 1 / n) * p - b * q) / ((a + 1 / n) * (d + 1 / n) - b * b), 4) AS w_quantity,
       round(((a + 1 / n) * q - b * p) / ((a + 1 / n) * (d + 1 / n) - b * b), 4) AS w_tax FROM s"""


@check("m10_ridge_two_predictors", sql=_RIDGE2, round_cols=["w_quantity", "w_tax"])
def m10x(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.col("l_extendedprice").alias("label"))
    li = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(li)
    m = MO.make_estimator("Ridge", "regresion", li.count()).fit(li)
    return spark.createDataFrame([tuple(round(float(w), 4) for w in m.coefficients)], "w_quantity double, w_tax double")


@check("m7_gaussian_nb_parameters", round_cols=["mean", "variance"], sql="""
WITH l AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_quantity, l_discount, l_tax FROM lineitem),
     s AS (SELECT label, 'l_quantity' AS feature, avg(l_quantity) AS mean, var_pop(l_quantity) AS v FROM l GROUP BY label
           UNION ALL SELECT label, 'l_discount', avg(l_discount), var_pop(l_discount) FROM l GROUP BY label
           UNION ALL SELECT label, 'l_tax', avg(l_tax), var_pop(l_tax) FROM l GROUP BY label),
     e AS (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)) AS eps FROM l)
SELECT CAST(label AS DOUBLE) AS label, feature, mean, v + eps AS variance FROM s, e""")
def m7x(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    feats = ["l_quantity", "l_discount", "l_tax"]
    li = VectorAssembler(inputCols=feats, outputCol="features").transform(li)
    m = NaiveBayes(modelType="gaussian").fit(li)
    rows = []
    labels = [0.0, 1.0]
    for ci, lab in enumerate(labels):
        for fj, f in enumerate(feats):
            rows.append((lab, f, float(m.theta[ci, fj]), float(m.sigma[ci, fj])))
    return spark.createDataFrame(rows, "label double, feature string, mean double, variance double")


@check("m20_benchmark_ranking")
def m20(spark, sf):
    """Three classifiers with their cross-validation."""
    res = MO.benchmark(_docs_data(spark, sf), "clasificacion", "run_bench",
                       models=["LogisticRegression", "DecisionTree", "GaussianNB"], cv_folds=5)
    return res.run_metrics


@check("m20_benchmark_classifiers")
def m20c(spark, sf):
    """All classifiers but the boosted ones (m4 and m8 train those), without cross-validation."""
    names = [n for n in MO.CLASSIFICATION_MODELS if n not in ("GradientBoosting", "AdaBoost")]
    return MO.benchmark(_docs_data(spark, sf), "clasificacion", "run_all", models=names, cv_folds=0).run_metrics


@check("m20_benchmark_regressors")
def m20r(spark, sf):
    """All regressors with their cross-validation."""
    return MO.benchmark(_reg_data(spark, sf), "regresion", "run_all_reg", cv_folds=5).run_metrics


QUICK_MODELS = ["LogisticRegression", "DecisionTree", "RandomForest", "KNeighbors", "GaussianNB"]


def _saved(spark, sf, run_id):
    """Five classifiers, trained and saved: the prepared data, (run_id, model, path, kind)."""
    data = _docs_data(spark, sf)
    res = MO.benchmark(data, "clasificacion", run_id, models=QUICK_MODELS, cv_folds=0)
    return data, MO.save_models(res, f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}")


@check("m21_save_and_reload_predictions", sql="""
WITH m AS (SELECT unnest(['LogisticRegression', 'DecisionTree', 'RandomForest', 'KNeighbors', 'GaussianNB']) AS model)
SELECT 'run_save' AS run_id, model, CAST(doc_id AS VARCHAR) AS row_key, CAST(quality AS DOUBLE) AS label, true AS has_prediction
FROM m, labels JOIN documents USING (doc_id)
WHERE CAST(('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 < 0.2""")
def m21(spark, sf):
    """Every saved model is loaded again and predicts every test row a class."""
    data, paths = _saved(spark, sf, "run_save")
    frames = [MO.predictions_of(MO.load_model(r["path"], r["kind"]), data.where(F.col("is_test")), "run_save", r["model"])
              for r in paths.collect()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("run_id", "model", "row_key", "label", F.col("prediction").isin(0.0, 1.0).alias("has_prediction"))


# =========================================================================== attribution
from qualab.operators import explain as X  # noqa: E402

LI_KEY = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"


def _li_linear(spark, sf, feats):
    li = table(spark, sf, "lineitem").withColumn(
        "row_key", F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    li = VectorAssembler(inputCols=feats, outputCol="features").transform(li)
    m = LinearRegression(solver="normal", standardization=False, labelCol="l_extendedprice").fit(li)
    return li, m, {f: float(w) for f, w in zip(feats, m.coefficients)}


SQL_OLS2 = """
ols AS (SELECT (vd * cq - cqd * cd) / (vq * vd - cqd * cqd) AS wq, (vq * cd - cqd * cq) / (vq * vd - cqd * cqd) AS wd,
               mq, md
        FROM (SELECT var_pop(l_quantity) AS vq, var_pop(l_discount) AS vd, covar_pop(l_quantity, l_discount) AS cqd,
                     covar_pop(l_quantity, l_extendedprice) AS cq, covar_pop(l_discount, l_extendedprice) AS cd,
                     avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem) AS m),
shap AS (SELECT {key} AS row_key, 'l_quantity' AS feature, l_quantity AS value, wq * (l_quantity - mq) AS shap FROM lineitem, ols
         UNION ALL SELECT {key}, 'l_discount', l_discount, wd * (l_discount - md) FROM lineitem, ols)""".format(key=LI_KEY)


@check("x1_linear_shap", round_cols=["value", "shap"], sql=f"WITH {SQL_OLS2} SELECT * FROM shap")
def x1(spark, sf):
    li, _, w = _li_linear(spark, sf, ["l_quantity", "l_discount"])
    return X.linear_shap(li, w)


@check("x2_importance", round_cols=["importance"], sql=f"""
WITH {SQL_OLS2}
SELECT feature, avg(abs(shap)) AS importance, row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS rank
FROM shap GROUP BY feature""")
def x2(spark, sf):
    li, _, w = _li_linear(spark, sf, ["l_quantity", "l_discount"])
    return X.importance(X.linear_shap(li, w))


@check("o4_report_importances", round_cols=["importance"], sql=f"""
WITH {SQL_OLS2}
SELECT feature, avg(abs(shap)) AS importance, row_number() OVER (ORDER BY avg(abs(shap)) DESC, feature) AS rank
FROM shap GROUP BY feature""")
def o4(spark, sf):
    li, _, w = _li_linear(spark, sf, ["l_quantity", "l_discount"])
    return R.report_importances(X.importance(X.linear_shap(li, w), top=None).drop("rank"), top=20)


@check("x3_sample_rows", round_cols=["o_totalprice"], sql="""
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY CAST(('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0
LIMIT 1000""")
def x3(spark, sf):
    return X.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], n=1000)


@check("x4_beeswarm", round_cols=["shap", "value", "value_scaled"], sql=f"""
WITH {SQL_OLS2}
SELECT row_key, feature, shap, value,
       CASE WHEN max(value) OVER (PARTITION BY feature) > min(value) OVER (PARTITION BY feature)
            THEN (value - min(value) OVER (PARTITION BY feature))
                 / (max(value) OVER (PARTITION BY feature) - min(value) OVER (PARTITION BY feature)) ELSE 0.5 END AS value_scaled
FROM shap""")
def x4(spark, sf):
    li, _, w = _li_linear(spark, sf, ["l_quantity", "l_discount"])
    return X.beeswarm(X.linear_shap(li, w))


@check("x1_permutation_shap_any_model")
def x1p(spark, sf):
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    data, state = MO.prepare_model_data(docs.drop("toxic"), "quality", "clasificacion", ["doc_id"])
    train = data.where(~F.col("is_test"))
    model = MO.make_estimator("RandomForest", "clasificacion", train.count(), 2).fit(train)
    return X.permutation_shap(model, data.where(F.col("is_test")), state["features"], data.where(~F.col("is_test")),
                              permutations=32)


@check("v13_artefacts_available", sql="""
SELECT 'run_art' AS run_id, CAST(5 * least(count(DISTINCT quality) - 1, 1) AS BIGINT) AS available, CAST(5 AS BIGINT) AS models,
       count(DISTINCT quality) > 1 AS complete FROM labels""")
def v13(spark, sf):
    return R.artefacts_available(_saved(spark, sf, "run_art")[1])


@check("c11_analyze_model")
def c11(spark, sf):
    data = _docs_data(spark, sf)
    out = C.analyze_model(data, lambda: NaiveBayes(modelType="gaussian"), "clasificacion", "run_c11", "GaussianNB")
    return out["diagnosis"]


# heavy fits last: one failure cannot take the checks above with it
for _name, _id in [("LogisticRegression", "m1"), ("DecisionTree", "m2"), ("RandomForest", "m3"),
                   ("GradientBoosting", "m4"), ("SVC", "m5"), ("KNeighbors", "m6"), ("GaussianNB", "m7"),
                   ("AdaBoost", "m8")]:
    check(f"{_id}_{_name.lower()}_classifier_predictions")(_model_check(_name, "clasificacion"))

for _name, _id in [("LinearRegression", "m9"), ("Ridge", "m10"), ("Lasso", "m11"), ("ElasticNet", "m12"),
                   ("DecisionTree", "m13"), ("RandomForest", "m14"), ("GradientBoosting", "m15"), ("SVR", "m16"),
                   ("KNeighbors", "m17"), ("AdaBoost", "m18")]:
    check(f"{_id}_{_name.lower()}_regressor_predictions")(_model_check(_name, "regresion"))
