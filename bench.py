"""Benchmark: headline queries on $BENCH_SF_DIR (default sf0.1) with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf"}.
Each query is executed in full with the ``noop`` sink (no collection to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from qualab.operators import dedup as D  # noqa: E402
from qualab.operators import metrics as M  # noqa: E402
from qualab.operators import profile as P  # noqa: E402
from qualab.operators import explain as X  # noqa: E402
from qualab.operators import models as MO  # noqa: E402
from qualab.operators import transform as TR  # noqa: E402
from qualab.operators import validate as V  # noqa: E402
from qualab.operators import crossval as C  # noqa: E402
from qualab.plans import runs_fixture as RF  # noqa: E402
from qualab.plans.fixtures import table  # noqa: E402
from qualab.session import build_session  # noqa: E402


def model_data(spark, sf):
    """Regression over labelled documents: length from language, source and labels."""
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    return MO.prepare_model_data(docs, "n_chars", "regresion", ["doc_id"])[0]


def fit(spark, sf, name):
    data = model_data(spark, sf)
    train = data.where(~F.col("is_test"))
    model = MO.make_estimator(name, "regresion", train.count()).fit(train)
    return MO.predictions_of(model, data.where(F.col("is_test")), "bench", name)


def shap(spark, sf):
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    data, state = MO.prepare_model_data(docs, "n_chars", "regresion", ["doc_id"])
    train = data.where(~F.col("is_test"))
    model = MO.make_estimator("LinearRegression", "regresion", 1).fit(train)
    return X.permutation_shap(model, data.where(F.col("is_test")), state["features"], train, permutations=32)


def tree_shap(spark, sf):
    data = model_data(spark, sf)
    train = data.where(~F.col("is_test"))
    model = MO.make_estimator("RandomForest", "regresion", 1).fit(train)
    names = [f"f{i}" for i in range(len(train.select("features").first()[0]))]
    return X.explain(model, data.where(F.col("is_test")), names, train, background_rows=50)


def cv(spark, sf):
    """Five folds of the linear model; a fold without a score stays NULL."""
    train = C.assign_folds(model_data(spark, sf).where(~F.col("is_test")), ["row_key"]).persist()
    est = MO.make_estimator("LinearRegression", "regresion", 1)
    scores = C.cv_scores(train, lambda a, b: MO.score_of(MO.predictions_of(est.fit(a), b, "bench", "lr"), "regresion"))
    train.unpersist()
    return spark.createDataFrame(scores, "fold int, score double")


def headline(spark, sf):
    li = lambda: table(spark, sf, "lineitem")
    do = lambda: table(spark, sf, "dirty_orders")
    return {
        "a12_quality_score_lineitem": lambda: P.quality_score(li()),
        "a11_column_stats_orders": lambda: P.column_stats(do()),
        "a6_outliers_iqr_lineitem": lambda: P.outliers(li()),
        "a14_numeric_describe": lambda: P.numeric_describe(li()),
        "a20_box_by_class": lambda: P.box_stats(li(), "l_extendedprice", "l_returnflag"),
        "d2_keep_first": lambda: D.drop_duplicates(table(spark, sf, "dup_orders"), ["o_custkey"], "first",
                                                   order_by=["o_orderdate", "o_orderkey", "seq"]),
        "d6_merge_duplicates": lambda: D.merge_duplicates(table(spark, sf, "dup_null_keys"), ["grp", "prio"],
                                                          {"o_totalprice": "median", "o_orderstatus": "mode"},
                                                          order_by=["o_orderkey"]),
        "t10_dates_mixed": lambda: TR.standardize_dates(table(spark, sf, "text_dates").select("o_orderkey", "d_mixed"),
                                                       "d_mixed", "ISO"),
        "v4_v5_text_suggestions": lambda: V.text_type_suggestions(table(spark, sf, "text_dates")),
        "e2_classification_report": lambda: M.classification_report(table(spark, sf, "pred_binary")),
        "e5_roc_points": lambda: M.roc_points(table(spark, sf, "pred_binary")),
        "e15_residual_diagnosis": lambda: M.residual_diagnosis(table(spark, sf, "pred_reg")),
        "m9_fit_linear_regression": lambda: fit(spark, sf, "LinearRegression"),
        "m17_knn_regression": lambda: fit(spark, sf, "KNeighbors"),
        "x1_permutation_shap": lambda: shap(spark, sf),
        "x1_tree_shap_forest": lambda: tree_shap(spark, sf),
        "c2_cv_scores": lambda: cv(spark, sf),
        "c2_cv_summary": lambda: C.cv_summary(RF.fold_scores(spark, sf)),
    }


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, app_name="qualab-bench")
    # warm-up (not timed): JVM start, class loading and JIT on the smallest tables
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        P.quality_score(table(spark, warm, "lineitem")).write.format("noop").mode("overwrite").save()
    times = {}
    for name, build in headline(spark, sf).items():
        t0 = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
