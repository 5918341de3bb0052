"""Checked queries for the run store, ranking, readiness and report tables
(R1-R4, H2/H4/H5, V12/V14, O1-O3/O5, P6, S1/S2/S4-S7/S9)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from qualab.operators import features as FE
from qualab.operators import profile as P
from qualab.operators import rank as R
from qualab.plans import runs_fixture as RF
from qualab.plans.checks_profile import DO_ALL, DO_NUM, sql_nulls_by_column, sql_quality_score
from qualab.plans.fixtures import table
from qualab.plans.registry import check
from qualab.session import ensure_checkpoint_dir
from qualab.sources import files as S
from qualab.sources.store import Store, latest, main_metric_rows

FX = RF.FIXTURES
HIGHER = "('accuracy', 'precision', 'recall', 'f1', 'r2', 'auc')"


def _sql_recommend(criterion: str | None) -> str:
    crit = (f"'{criterion}'" if criterion else
            "CASE WHEN problem_type = 'clasificacion' THEN 'accuracy' ELSE 'r2' END")
    return f"""
SELECT run_id, model, criterion, value FROM (
  SELECT run_id, model, criterion, v AS value,
         row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN criterion IN {HIGHER} THEN v ELSE -v END DESC, model) AS rk
  FROM (SELECT mm.run_id, mm.model, c.criterion,
               coalesce(x.value, CASE WHEN c.criterion IN {HIGHER} THEN 0.0 ELSE 'inf'::DOUBLE END) AS v
        FROM (SELECT DISTINCT run_id, model FROM run_metrics) AS mm
        JOIN (SELECT run_id, {crit} AS criterion FROM runs) AS c ON c.run_id = mm.run_id
        LEFT JOIN run_metrics AS x ON x.run_id = mm.run_id AND x.model = mm.model AND x.metric = c.criterion) AS j) AS q
WHERE rk = 1"""


def _stores(spark):
    return Store(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


@check("r1_recommend_auto", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables(_sql_recommend(None)))
def r1(spark, sf):
    return R.recommend(RF.runs(spark, sf), RF.run_metrics(spark, sf))


@check("r1_recommend_lower_better", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables(_sql_recommend("mse")))
def r1m(spark, sf):
    return R.recommend(RF.runs(spark, sf), RF.run_metrics(spark, sf), "mse")


_CMP = R.COMPARE_METRICS
_CMP_ROUND = list(_CMP)


@check("r2_comparison_table", fixtures=FX, round_cols=_CMP_ROUND, sql=RF.with_run_tables(f"""
, best AS ({_sql_recommend(None)}),
  wide AS (SELECT run_id, model, {', '.join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in _CMP)}
           FROM run_metrics GROUP BY run_id, model)
SELECT w.run_id, w.model, {', '.join('w.' + m for m in _CMP)}, w.model = b.model AS recommended, b.criterion,
       row_number() OVER (PARTITION BY w.run_id ORDER BY (CASE WHEN b.criterion IN {HIGHER} THEN -1 ELSE 1 END) *
         (CASE b.criterion {' '.join(f"WHEN '{m}' THEN w.{m}" for m in _CMP)} END) ASC NULLS LAST, w.model) AS position
FROM wide AS w JOIN best AS b ON b.run_id = w.run_id""").replace("\n, best AS", ", best AS"))
def r2(spark, sf):
    return R.comparison_table(RF.runs(spark, sf), RF.run_metrics(spark, sf))


@check("r3_leaderboard", fixtures=FX, round_cols=_CMP_ROUND + ["cv_mean", "cv_std"], sql=RF.with_run_tables(f"""
, cv AS (SELECT run_id, model, avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM fold_scores WHERE split = 'test'
         GROUP BY run_id, model),
  wide AS (SELECT run_id, model, {', '.join(f"round(max(value) FILTER (WHERE metric = '{m}'), 4) AS {m}" for m in _CMP)}
           FROM run_metrics GROUP BY run_id, model)
SELECT w.*, cv.cv_mean, cv.cv_std, printf('%.4f', cv.cv_mean) || ' ± ' || printf('%.4f', cv.cv_std) AS cv,
       row_number() OVER (PARTITION BY w.run_id ORDER BY w.accuracy DESC NULLS LAST, w.model) AS position
FROM wide AS w LEFT JOIN cv USING (run_id, model)""").replace("\n, cv AS", ", cv AS"))
def r3(spark, sf):
    return R.leaderboard(RF.run_metrics(spark, sf), RF.fold_scores(spark, sf), "accuracy")


@check("r4_pick_model", fixtures=FX, sql=RF.with_run_tables(f"""
, best AS ({_sql_recommend(None)})
SELECT run_id, model, CASE p WHEN 0 THEN 'named' WHEN 1 THEN 'best' ELSE 'first' END AS reason FROM (
  SELECT m.run_id, m.model, CASE WHEN m.model = 'm_mixed' THEN 0 WHEN m.model = b.model THEN 1 ELSE 2 END AS p,
         row_number() OVER (PARTITION BY m.run_id ORDER BY CASE WHEN m.model = 'm_mixed' THEN 0
                            WHEN m.model = b.model THEN 1 ELSE 2 END, m.model) AS r
  FROM (SELECT DISTINCT run_id, model FROM run_metrics) AS m LEFT JOIN best AS b ON b.run_id = m.run_id) AS q
WHERE r = 1""").replace("\n, best AS", ", best AS"))
def r4(spark, sf):
    return R.pick_model(RF.runs(spark, sf), RF.run_metrics(spark, sf), "m_mixed")


@check("h5_history_main_metric", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables("""
SELECT run_id, user_id, created_at, dataset, target, problem_type, best_model, metric, value FROM (
  SELECT r.run_id, r.user_id, r.created_at, r.dataset, r.target, r.problem_type, m.model AS best_model, m.metric, m.value,
         row_number() OVER (PARTITION BY r.run_id ORDER BY m.value DESC NULLS LAST, m.model) AS k
  FROM runs AS r JOIN run_metrics AS m ON m.run_id = r.run_id
   AND m.metric = CASE WHEN r.problem_type = 'clasificacion' THEN 'accuracy' ELSE 'r2' END) AS q WHERE k = 1"""))
def h5(spark, sf):
    return main_metric_rows(RF.runs(spark, sf), RF.run_metrics(spark, sf))


@check("h2_h4_latest_runs", fixtures=FX, sql=RF.with_run_tables("""
SELECT * FROM runs WHERE user_id = 'u1' ORDER BY created_at DESC, run_id LIMIT 2"""))
def h4(spark, sf):
    return latest(RF.runs(spark, sf), user_id="u1", n=2)


@check("v12_results_ready", fixtures=FX, sql=RF.with_run_tables("""
SELECT r.run_id, coalesce(p.n, 0) > 0 AND coalesce(m.k, 0) > 0 AND r.problem_type IS NOT NULL AND r.target IS NOT NULL AS ok,
       list_filter([CASE WHEN r.problem_type IS NULL THEN 'problem_type' END, CASE WHEN r.target IS NULL THEN 'target' END,
                    CASE WHEN coalesce(p.n, 0) = 0 THEN 'test_split' END,
                    CASE WHEN coalesce(m.k, 0) = 0 THEN 'successful_model' END], lambda x: x IS NOT NULL) AS missing,
       coalesce(p.n, 0) AS n_test, coalesce(m.k, 0) AS n_models
FROM runs AS r LEFT JOIN (SELECT run_id, count(*) AS n FROM predictions GROUP BY run_id) AS p ON p.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(DISTINCT model) AS k FROM run_metrics GROUP BY run_id) AS m ON m.run_id = r.run_id"""))
def v12(spark, sf):
    return R.results_ready(RF.runs(spark, sf), RF.run_metrics(spark, sf), RF.predictions(spark, sf))


@check("v14_evaluation_ready", fixtures=FX, sql=RF.with_run_tables("""
SELECT coalesce(p.run_id, m.run_id) AS run_id, coalesce(p.model, m.model) AS model, coalesce(p.n, 0) > 0 AS has_test,
       false AS has_artefact,
       CASE WHEN r.problem_type = 'clasificacion' THEN coalesce(p.np, 0) > 0 ELSE true END AS has_probabilities,
       coalesce(m.k, 0) > 0 AS has_metrics, coalesce(r.problem_type IN ('clasificacion', 'regresion'), false) AS known_type
FROM (SELECT run_id, model, count(*) AS n, count(probability) AS np FROM predictions GROUP BY run_id, model) AS p
FULL JOIN (SELECT run_id, model, count(*) AS k FROM run_metrics GROUP BY run_id, model) AS m
  ON m.run_id = p.run_id AND m.model = p.model
LEFT JOIN runs AS r ON r.run_id = coalesce(p.run_id, m.run_id)"""))
def v14(spark, sf):
    return R.evaluation_ready(RF.runs(spark, sf), RF.run_metrics(spark, sf), RF.predictions(spark, sf))


@check("p6_predictor_set_changed", fixtures=FX, sql=RF.with_run_tables("""
SELECT run_id, list_sort(list_filter(predictors, lambda x: NOT list_contains(['l_quantity', 'l_tax'], x))) AS removed,
       list_sort(list_filter(['l_quantity', 'l_tax'], lambda x: NOT list_contains(predictors, x))) AS added,
       len(list_filter(predictors, lambda x: NOT list_contains(['l_quantity', 'l_tax'], x))) > 0
         OR len(list_filter(['l_quantity', 'l_tax'], lambda x: NOT list_contains(predictors, x))) > 0 AS changed
FROM runs"""))
def p6(spark, sf):
    out = FE.predictor_set_changed(RF.runs(spark, sf), ["l_quantity", "l_tax"])
    return out.select("run_id", F.array_sort("removed").alias("removed"), F.array_sort("added").alias("added"), "changed")


@check("o1_report_quality", fixtures=["dirty_orders"], sql=f"""
WITH s AS ({sql_quality_score('dirty_orders', DO_ALL, DO_NUM)}), nb AS ({sql_nulls_by_column('dirty_orders', DO_ALL)})
SELECT 'quality' AS section, item, value FROM (
  SELECT 'n_rows' AS item, CAST(n_rows AS VARCHAR) AS value FROM s UNION ALL SELECT 'n_columns', CAST(n_columns AS VARCHAR) FROM s
  UNION ALL SELECT 'null_pct', printf('%.2f', null_pct) FROM s
  UNION ALL SELECT 'duplicate_rows', CAST(duplicate_rows AS VARCHAR) FROM s
  UNION ALL SELECT 'duplicate_pct', printf('%.2f', duplicate_pct) FROM s
  UNION ALL SELECT 'completeness', printf('%.2f', completeness) FROM s
  UNION ALL SELECT 'score', printf('%.2f', score) FROM s UNION ALL SELECT 'grade', grade FROM s) AS h
UNION ALL
SELECT * FROM (SELECT 'quality_nulls', col_name, printf('%.2f', pct) FROM nb WHERE nulls > 0
               ORDER BY pct DESC, col_name LIMIT 10) AS t""")
def o1(spark, sf):
    df = table(spark, sf, "dirty_orders")
    return R.report_quality(P.quality_score(df), P.nulls_by_column(df))


@check("o2_report_models", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables(f"""
, best AS ({_sql_recommend(None)}),
  pr AS (SELECT *, list_position({list(_CMP)}, metric) AS o FROM run_metrics WHERE metric IN {tuple(_CMP)}),
  firsts AS (SELECT run_id, list_slice(list_sort(list_distinct(list(o))), 1, 5) AS keep FROM pr GROUP BY run_id)
SELECT pr.run_id, pr.model, pr.metric, pr.value, pr.model = b.model AS best, pr.metric = b.criterion AS main_metric
FROM pr JOIN firsts AS f ON f.run_id = pr.run_id AND list_contains(f.keep, pr.o) JOIN best AS b ON b.run_id = pr.run_id""")
       .replace("\n, best AS", ", best AS"))
def o2(spark, sf):
    return R.report_models(RF.runs(spark, sf), RF.run_metrics(spark, sf))


@check("o3_report_selection", fixtures=FX, sql=RF.with_run_tables(f"""
, best AS ({_sql_recommend(None)})
SELECT run_id, 'selection' AS section, 'model' AS item, model AS value FROM best
UNION ALL SELECT run_id, 'selection', 'criterion', criterion FROM best
UNION ALL SELECT run_id, 'selection', 'criterion_value', printf('%.4f', value) FROM best
UNION ALL SELECT m.run_id, 'selection_metrics', m.metric, printf('%.4f', m.value)
FROM run_metrics AS m JOIN best AS b ON b.run_id = m.run_id AND b.model = m.model""").replace("\n, best AS", ", best AS"))
def o3(spark, sf):
    return R.report_selection(RF.runs(spark, sf), RF.run_metrics(spark, sf))


@check("o5_report_conclusions", fixtures=FX + ["dirty_orders"], sql=RF.with_run_tables(f"""
, s AS ({sql_quality_score('dirty_orders', DO_ALL, DO_NUM)}), best AS ({_sql_recommend(None)})
SELECT CAST(NULL AS VARCHAR) AS run_id, 'conclusion' AS section,
       CASE WHEN null_pct > 20 THEN 'high_nulls' WHEN null_pct > 5 THEN 'moderate_nulls' ELSE 'ok_nulls' END AS item,
       printf('%.2f', null_pct) AS value FROM s
UNION ALL SELECT run_id, 'conclusion', 'best_model', model || ':' || criterion || ':' || printf('%.4f', value) FROM best
UNION ALL SELECT NULL, 'conclusion', 'closing', 'review_before_production' FROM s""").replace("\n, s AS", ", s AS"))
def o5(spark, sf):
    df = table(spark, sf, "dirty_orders")
    return R.report_conclusions(P.quality_score(df), RF.runs(spark, sf), RF.run_metrics(spark, sf))


@check("s1_csv_roundtrip", round_cols=["o_totalprice"], sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def s1(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf, "orders").write.option("header", True).csv(path)
    df = S.read_csv(spark, path)
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@check("s2_load_metadata", sql="""
SELECT position, col_name, dtype, (SELECT count(*) FROM lineitem) AS n_rows, 11 AS n_columns, 'parquet' AS origin
FROM (VALUES (0, 'l_orderkey', 'bigint'), (1, 'l_partkey', 'bigint'), (2, 'l_suppkey', 'bigint'), (3, 'l_linenumber', 'int'),
             (4, 'l_quantity', 'double'), (5, 'l_extendedprice', 'double'), (6, 'l_discount', 'double'), (7, 'l_tax', 'double'),
             (8, 'l_returnflag', 'string'), (9, 'l_linestatus', 'string'), (10, 'l_shipdate', 'timestamp_ntz'))
     AS t(position, col_name, dtype)""")
def s2(spark, sf):
    return S.load_metadata(table(spark, sf, "lineitem"), "parquet").drop("files")


@check("s4_s5_save_and_load_dataset", round_cols=["c_acctbal"], sql="SELECT * FROM customer")
def s45(spark, sf):
    st = _stores(spark)
    ds = st.save_dataset(table(spark, sf, "customer"), "customers", "copy", "u1")
    return st.load_dataset(ds)


@check("s6_s7_s8_catalog", sql="""
SELECT 'parts' AS name, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, 'u2' AS user_id FROM part
UNION ALL SELECT 'nations', count(*), 3, 'u2' FROM nation""")
def s678(spark, sf):
    st = _stores(spark)
    st.save_dataset(table(spark, sf, "region"), "regions", "", "u1")
    st.save_dataset(table(spark, sf, "nation"), "nations", "", "u2")
    gone = st.save_dataset(table(spark, sf, "supplier"), "suppliers", "", "u2")
    st.save_dataset(table(spark, sf, "part"), "parts", "", "u2")
    st.delete_dataset(gone)
    return st.datasets("u2").select("name", "n_rows", "n_columns", "user_id")


@check("s9_preview", round_cols=["o_totalprice"], sql="SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def s9(spark, sf):
    return S.preview(table(spark, sf, "orders"), 10, ["o_orderkey"])


# ------------------------------------------------------------------ store round trips
@check("h1_save_run_and_read_metrics", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables(
    "SELECT run_id, model, metric, value FROM run_metrics"))
def h1(spark, sf):
    st = _stores(spark)
    runs = RF.runs(spark, sf)
    rm = RF.run_metrics(spark, sf).cache()   # one computation shared by the per-run appends
    for r in runs.collect():
        st.save_run({"run_id": r["run_id"], "user_id": r["user_id"], "created_at": r["created_at"],
                     "problem_type": r["problem_type"], "target": r["target"], "predictors": r["predictors"],
                     "dataset": r["dataset"]}, rm.where(F.col("run_id") == r["run_id"]))
    return st.run_metrics()


@check("h6_history_newest", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables("""
SELECT * FROM (SELECT run_id, user_id, created_at, dataset, target, problem_type, best_model, metric, value FROM (
  SELECT r.run_id, r.user_id, r.created_at, r.dataset, r.target, r.problem_type, m.model AS best_model, m.metric, m.value,
         row_number() OVER (PARTITION BY r.run_id ORDER BY m.value DESC NULLS LAST, m.model) AS k
  FROM runs AS r JOIN run_metrics AS m ON m.run_id = r.run_id
   AND m.metric = CASE WHEN r.problem_type = 'clasificacion' THEN 'accuracy' ELSE 'r2' END) AS q WHERE k = 1) AS h
ORDER BY created_at DESC, run_id LIMIT 50"""))
def h6(spark, sf):
    st = _stores(spark)
    st.save_history(main_metric_rows(RF.runs(spark, sf), RF.run_metrics(spark, sf)))
    return latest(st.history(), n=50)


@check("h8_r5_audit_model_choice", fixtures=FX, sql=RF.with_run_tables(f"""
SELECT 'u1' AS user_id, 'MODEL_SELECTED' AS action, 'run' AS entity, run_id AS entity_id,
       model || ' by ' || criterion AS details FROM ({_sql_recommend(None)}) AS b"""))
def h8(spark, sf):
    st = _stores(spark)
    choice = R.recommend(RF.runs(spark, sf), RF.run_metrics(spark, sf))
    events = choice.select(F.lit("u1").alias("user_id"), F.lit("MODEL_SELECTED").alias("action"),
                           F.lit("run").alias("entity"), F.col("run_id").alias("entity_id"),
                           F.concat_ws(" by ", "model", "criterion").alias("details"),
                           F.current_timestamp().cast("timestamp_ntz").alias("created_at"),
                           F.lit(None).cast("string").alias("session_id"))
    st.audit_batch(events)
    return st.audit_log().select("user_id", "action", "entity", "entity_id", "details")


@check("o6_report_store", fixtures=["dirty_orders"], sql=f"""
WITH s AS ({sql_quality_score('dirty_orders', DO_ALL, DO_NUM)}), nb AS ({sql_nulls_by_column('dirty_orders', DO_ALL)})
SELECT 'quality' AS section, item, value FROM (
  SELECT 'n_rows' AS item, CAST(n_rows AS VARCHAR) AS value FROM s UNION ALL SELECT 'n_columns', CAST(n_columns AS VARCHAR) FROM s
  UNION ALL SELECT 'null_pct', printf('%.2f', null_pct) FROM s
  UNION ALL SELECT 'duplicate_rows', CAST(duplicate_rows AS VARCHAR) FROM s
  UNION ALL SELECT 'duplicate_pct', printf('%.2f', duplicate_pct) FROM s
  UNION ALL SELECT 'completeness', printf('%.2f', completeness) FROM s
  UNION ALL SELECT 'score', printf('%.2f', score) FROM s UNION ALL SELECT 'grade', grade FROM s) AS h
UNION ALL
SELECT * FROM (SELECT 'quality_nulls', col_name, printf('%.2f', pct) FROM nb WHERE nulls > 0
               ORDER BY pct DESC, col_name LIMIT 10) AS t""")
def o6(spark, sf):
    st = _stores(spark)
    df = table(spark, sf, "dirty_orders")
    rid = st.save_report(R.report_quality(P.quality_score(df), P.nulls_by_column(df)), "quality report")
    return st.report(rid).where(F.col("section") != "_content").select("section", "item", "value")


@check("a25_quality_bundle_written")
def a25(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/quality-{uuid.uuid4().hex}"
    P.write_quality_bundle(table(spark, sf, "dirty_orders"), path, "run_q")
    return spark.read.parquet(path).groupBy("run_id", "section").agg(F.count(F.lit(1)).alias("n"))


@check("a25_quality_bundle_values", fixtures=["dirty_orders"], round_cols=["value"], sql=f"""
WITH s AS ({sql_quality_score('dirty_orders', DO_ALL, DO_NUM)}), nb AS ({sql_nulls_by_column('dirty_orders', DO_ALL)})
SELECT 'global' AS section, 'score' AS item, score AS value FROM s
UNION ALL SELECT 'nulls', col_name, CAST(nulls AS DOUBLE) FROM nb""")
def a25_values(spark, sf):
    """What the written bundle holds, read again: the score and each column's missing values."""
    path = f"{ensure_checkpoint_dir(spark)}/quality-{uuid.uuid4().hex}"
    P.write_quality_bundle(table(spark, sf, "dirty_orders"), path, "run_q")
    of = lambda name: F.get_json_object("payload", f"$.{name}")
    rows = spark.read.parquet(path).where(F.col("section").isin("global", "nulls"))
    score = F.col("section") == "global"
    return rows.select("section", F.when(score, F.lit("score")).otherwise(of("col_name")).alias("item"),
                       F.when(score, of("score")).otherwise(of("nulls")).cast("double").alias("value"))


@check("h7_latest_configs", sql="""
SELECT r_name AS target, ['p' || CAST(r_regionkey AS VARCHAR), r_name] AS predictors, CAST(0.2 AS DOUBLE) AS test_size
FROM region ORDER BY r_regionkey DESC LIMIT 3""")
def h7(spark, sf):
    """One configuration a region, each saved by a write of its own; the newest three of the user."""
    st = _stores(spark)
    first = dt.datetime(2024, 1, 1)
    for r in table(spark, sf, "region").collect():
        st.save_config({"user_id": "u1" if r["r_regionkey"] >= 0 else None, "created_at": first + dt.timedelta(days=r["r_regionkey"]),
                        "problem_type": "regresion", "target": r["r_name"], "predictors": [f"p{r['r_regionkey']}", r["r_name"]], "test_size": 0.2})
    st.save_config({"user_id": "u2", "created_at": first + dt.timedelta(days=99), "target": "other"})
    return latest(st.configs(), user_id="u1", n=3).select("target", "predictors", "test_size")


@check("s3_guard_empty_input", sql="""
SELECT status, count(o_orderkey) = 0 AS empty, count(o_orderkey) AS n_rows
FROM (SELECT unnest(['F', 'O', 'P', 'none']) AS status) AS s LEFT JOIN orders ON o_orderstatus = status GROUP BY status""")
def s3(spark, sf):
    """The guard lets inputs with rows pass and turns an empty one into an error record."""
    rows = []
    for status in ("F", "O", "P", "none"):
        df, error = S.guard_empty(table(spark, sf, "orders").where(F.col("o_orderstatus") == status))
        rows.append((status, error is not None and error["error"] == "empty_input", 0 if df is None else df.count()))
    return spark.createDataFrame(rows, "status string, empty boolean, n_rows long")


@check("h3_run_by_id", fixtures=FX, round_cols=["value"], sql=RF.with_run_tables("""
SELECT r.run_id, r.problem_type, r.target, m.model, m.metric, m.value
FROM runs AS r JOIN run_metrics AS m ON m.run_id = r.run_id WHERE r.run_id = 'run_bin' AND m.model = 'm_mixed'"""))
def h3(spark, sf):
    from qualab.sources.store import run_by_id
    return run_by_id(RF.runs(spark, sf), RF.run_metrics(spark, sf), "run_bin", "m_mixed")
