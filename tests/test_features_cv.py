import math

import numpy as np
from pyspark.sql import functions as F

from qualab.operators import crossval as C
from qualab.operators import features as FE
from qualab.plans.fixtures import table


def test_split_is_partition_and_deterministic(spark, sf):
    o = table(spark, sf, "orders")
    a = FE.split_flag(o, ["o_orderkey"]).select("o_orderkey", "is_test")
    b = FE.split_flag(o.repartition(7), ["o_orderkey"]).select("o_orderkey", "is_test")
    assert a.exceptAll(b).count() == 0 and a.count() == o.count()
    share = a.agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.1 < share < 0.3


def test_stratified_folds_balanced(spark, sf):
    o = table(spark, sf, "orders")
    f = C.assign_folds(o, ["o_orderkey"], 5, label="o_orderstatus")
    assert f.count() == o.count()
    per = f.groupBy("o_orderstatus", "fold").count().groupBy("o_orderstatus").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in per)


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    sc = FE.fit_scaler(df, ["x"])
    assert math.isclose(sc["x"][1], float(np.std([1, 2, 3, 4])))
    assert FE.fit_scaler(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"])["x"][1] == 1.0


def test_prepare_for_ml_one_hot_and_impute(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "c string, v double")
    out = FE.prepare_for_ml(df).toPandas()
    assert set(out.columns) == {"v", "c_b", "c_nan"}
    assert out["v"].tolist() == [1.0, 2.0, 3.0] and out["c_nan"].tolist() == [0.0, 0.0, 1.0]


def test_cap_categories(spark):
    df = spark.createDataFrame([(f"v{i % 12}",) for i in range(120)] + [("v0",)], "c string")
    out = FE.cap_categories(df, "c")
    assert out.select("c").distinct().count() == 11 and out.where("c = 'OTROS'").count() == 20  # v8, v9 lose the tie


def test_cv_rules(spark):
    fs = spark.createDataFrame([("r", "m", f, "test", s) for f, s in enumerate([0.5, 0.52, 0.51, 0.5, 0.49])],
                               "run_id string, model string, fold int, split string, score double")
    r = C.simple_diagnosis(fs).first()
    assert r["overfitting"] == "improbable" and r["underfitting"] == "posible" and r["recommendations"] == ["underfit"]


def test_learning_curves_add_up_before_they_meet_sizes(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    from qualab.functions.hashing import hash_unit
    from qualab.plans import runs_fixture as RF

    rows = spark.range(400).select(F.lit("r").alias("run_id"), F.lit("m").alias("model"), F.col("id").cast("string").alias("row_key"),
                                   (F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("prediction"))
    empty = rows.limit(0)
    monkeypatch.setattr(RF, "table", lambda spark, sf, name: rows if name == "pred_binary" else empty)
    curve = RF.curve_scores(spark, sf)
    got = {(r["size"], r["fold"], r["split"]): r["score"] for r in curve.collect()}
    all_rows = rows.select("label", hash_unit(F.col("row_key")).alias("f"), hash_unit(F.col("row_key"), 7).alias("s")).collect()
    want = {}
    for size in RF.SIZES:
        for fold in range(5):
            for split in ("train", "test"):
                hits = [r["label"] for r in all_rows if (int(r["f"] * 5) == fold) == (split == "test") and (split == "test" or r["s"] < size)]
                if hits:
                    want[size, fold, split] = sum(hits) / len(hits)
    assert got == want
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("explode")  # the rows are added up below the listing of sizes
