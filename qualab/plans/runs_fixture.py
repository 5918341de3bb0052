"""Run-history tables derived from the prediction fixtures (Spark and SQL forms).

``runs``: one row per synthetic run, created_at taken from the source table;
``run_metrics``: E1-E3 metrics of the prediction tables in long form;
``fold_scores``: per-fold test score (accuracy / r2) with folds from a row-key hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualab.functions.hashing import hash_unit
from qualab.operators import metrics as M
from qualab.plans.checks_metrics import SQL_REG, sql_auc, sql_per_class
from qualab.plans.fixtures import table

K = "run_id, model"
RUN_DEFS = [  # run_id, user, problem type, target, predictors, dataset, source table, time column
    ("run_bin", "u1", "clasificacion", "l_returnflag", ["l_quantity", "l_discount"], "lineitem", "lineitem", "l_shipdate"),
    ("run_reg", "u2", "regresion", "o_totalprice", ["o_orderkey"], "orders", "orders", "o_orderdate"),
    ("run_multi", "u1", "clasificacion", "event_type", ["event_id"], "events", "events", "ts"),
]
FIXTURES = ["pred_binary", "pred_multi", "multi_scores", "pred_reg"]


def runs(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for rid, user, ptype, target, preds, ds, src, tcol in RUN_DEFS:
        r = table(spark, sf, src).agg(F.max(tcol).cast("timestamp_ntz").alias("created_at")).select(
            F.lit(rid).alias("run_id"), F.lit(user).alias("user_id"), "created_at", F.lit(ptype).alias("problem_type"),
            F.lit(target).alias("target"), F.array(*[F.lit(p) for p in preds]).alias("predictors"),
            F.lit(ds).alias("dataset"))
        out = r if out is None else out.unionByName(r)
    return out


def sql_runs() -> str:
    parts = []
    for rid, user, ptype, target, preds, ds, src, tcol in RUN_DEFS:
        arr = "[" + ", ".join(f"'{p}'" for p in preds) + "]"
        parts.append(f"SELECT '{rid}' AS run_id, '{user}' AS user_id, max({tcol}) AS created_at, '{ptype}' AS problem_type, "
                     f"'{target}' AS target, {arr} AS predictors, '{ds}' AS dataset FROM {src}")
    return "\nUNION ALL\n".join(parts)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pred_binary").unionByName(table(spark, sf, "pred_multi")) \
        .unionByName(table(spark, sf, "pred_reg"))


SQL_PREDICTIONS = "SELECT * FROM pred_binary UNION ALL SELECT * FROM pred_multi UNION ALL SELECT * FROM pred_reg"


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    b = M.classification_report(table(spark, sf, "pred_binary"))
    m = M.classification_report(table(spark, sf, "pred_multi"), score=None, class_scores=table(spark, sf, "multi_scores"))
    r = M.regression_metrics(table(spark, sf, "pred_reg"))
    return M.run_metrics_long(b.unionByName(m), r)


def _sql_report(pred: str, auc_sql: str, binary: bool) -> str:
    if binary:
        p = "coalesce(max(precision) FILTER (WHERE cls = 1.0), 0.0)"
        r = "coalesce(max(recall) FILTER (WHERE cls = 1.0), 0.0)"
        f = "coalesce(max(f1) FILTER (WHERE cls = 1.0), 0.0)"
    else:
        p, r, f = "avg(precision)", "avg(recall)", "avg(f1)"
    return f"""
SELECT m.*, a.auc FROM (
  SELECT {K}, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy, {p} AS precision, {r} AS recall, {f} AS f1
  FROM (WITH {sql_per_class(pred)} SELECT * FROM pc) AS pcx GROUP BY {K}) AS m
LEFT JOIN ({auc_sql}) AS a USING (run_id, model)"""


def sql_run_metrics() -> str:
    bin_auc = sql_auc("pred_binary", K, "label = 1.0", "probability")
    multi_auc = f"SELECT {K}, avg(auc) AS auc FROM ({sql_auc('multi_scores', 'run_id, model, class', 'label = class', 'score')}) AS q GROUP BY {K}"
    c = f"({_sql_report('pred_binary', bin_auc, True)}) UNION ALL ({_sql_report('pred_multi', multi_auc, False)})"
    parts = [f"SELECT {K}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM c" for m in ("accuracy", "precision", "recall", "f1", "auc")]
    parts += [f"SELECT {K}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM r" for m in ("r2", "mse", "rmse", "mae")]
    return f"SELECT * FROM (WITH c AS ({c}), r AS ({SQL_REG}) " + " UNION ALL ".join(parts) + ") AS rm"


def fold_scores(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    fold = F.floor(hash_unit(F.col("row_key")) * k).cast("int")
    cls = table(spark, sf, "pred_binary").unionByName(table(spark, sf, "pred_multi")).withColumn("fold", fold)
    acc = cls.groupBy("run_id", "model", "fold").agg(
        (F.count_if(F.col("label") == F.col("prediction")) / F.count(F.lit(1))).alias("score"))
    reg = table(spark, sf, "pred_reg").withColumn("fold", fold)
    r2 = M.regression_metrics(reg, ["run_id", "model", "fold"]).select("run_id", "model", "fold", F.col("r2").alias("score"))
    return acc.unionByName(r2).withColumn("split", F.lit("test"))


def sql_fold_scores(k: int = 5) -> str:
    fold = f"CAST(floor(CAST(('0x' || substr(md5('42|' || row_key), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 * {k}) AS INTEGER)"
    return f"""
SELECT run_id, model, fold, CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS score, 'test' AS split
FROM (SELECT *, {fold} AS fold FROM pred_binary UNION ALL SELECT *, {fold} AS fold FROM pred_multi) AS c GROUP BY run_id, model, fold
UNION ALL
SELECT run_id, model, fold, CASE WHEN var_pop(label) * count(*) > 0 THEN 1.0 - sum((label - prediction) * (label - prediction))
       / (var_pop(label) * count(*)) END AS score, 'test' AS split
FROM (SELECT *, {fold} AS fold FROM pred_reg) AS r GROUP BY run_id, model, fold"""


def with_run_tables(body: str) -> str:
    """SQL: runs / run_metrics / fold_scores / predictions CTEs before ``body``."""
    return (f"WITH runs AS ({sql_runs()}), run_metrics AS ({sql_run_metrics()}), "
            f"fold_scores AS ({sql_fold_scores()}), predictions AS ({SQL_PREDICTIONS})\n{body}")


SIZES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def curve_scores(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """(run_id, model, size, fold, split, score): accuracy of the synthetic classifiers on
    nested hash subsets of the training folds (train) and on the held-out fold (test)."""
    fold = F.floor(hash_unit(F.col("row_key")) * k).cast("int")
    sub = hash_unit(F.col("row_key"), 7)
    cls = table(spark, sf, "pred_binary").unionByName(table(spark, sf, "pred_multi")) \
        .select("run_id", "model", fold.alias("fold_of_row"), sub.alias("sub"),
                (F.col("label") == F.col("prediction")).cast("int").alias("hit"))
    # hits by fold and by the first size whose subset holds the row: only these few sums meet all sizes and folds
    steps = F.array(*[F.lit(s) for s in SIZES])
    least = F.get(F.filter(steps, lambda s: F.col("sub") < s), F.lit(0)).alias("least")
    parts = cls.groupBy("run_id", "model", "fold_of_row", least).agg(F.sum("hit").alias("hit"), F.count(F.lit(1)).alias("n"))
    rows = parts.select("*", F.explode(steps).alias("size")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    tagged = rows.select("run_id", "model", "size", "fold", "hit", "n",
                         F.when(F.col("fold_of_row") == F.col("fold"), F.lit("test"))
                          .when(F.col("least") <= F.col("size"), F.lit("train")).alias("split")).where(F.col("split").isNotNull())
    return tagged.groupBy("run_id", "model", "size", "fold", "split").agg((F.sum("hit") / F.sum("n")).alias("score"))


def sql_curve_scores(k: int = 5) -> str:
    h = "CAST(('0x' || substr(md5('{s}|' || row_key), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"
    sizes = "[" + ", ".join(str(s) for s in SIZES) + "]"
    return f"""
SELECT run_id, model, size, fold, split, CAST(sum(hit) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS score FROM (
  SELECT run_id, model, size, fold, hit,
         CASE WHEN fold_of_row = fold THEN 'test' WHEN sub < size THEN 'train' END AS split
  FROM (SELECT run_id, model, CAST(floor({h.format(s=42)} * {k}) AS INTEGER) AS fold_of_row, {h.format(s=7)} AS sub,
               CAST(label = prediction AS INTEGER) AS hit, unnest({sizes}) AS size
        FROM (SELECT * FROM pred_binary UNION ALL SELECT * FROM pred_multi) AS p) AS a,
       (SELECT range AS fold FROM range({k})) AS f) AS t
WHERE split IS NOT NULL GROUP BY run_id, model, size, fold, split"""


def with_curve_tables(body: str) -> str:
    return with_run_tables(f", curve_scores AS ({sql_curve_scores()})\n" + body).replace(
        ")\n, curve_scores", "), curve_scores")
