"""Checked queries for validation rules."""

from __future__ import annotations

from qualab.functions.parsing import DATE_LIKE_FORMATS, DATE_LIKE_PREFIXES, STRICT_NUMBER
from pyspark.sql import functions as F

from qualab.operators import validate as V
from qualab.plans.fixtures import table
from qualab.plans.registry import check, sql_union


def _sql_target_class(t: str, c: str) -> str:
    return f"""
WITH b AS (SELECT count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {t}),
     k AS (SELECT count(*) AS k, min(w) AS wmin, sum(w) AS wsum FROM (SELECT {c}, count(*) AS w FROM {t}
           WHERE {c} IS NOT NULL GROUP BY {c}) AS g),
     x AS (SELECT *, CAST(nulls AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 AS null_pct,
                  CAST(wmin AS DOUBLE) / CAST(wsum AS DOUBLE) AS share FROM b, k)
SELECT CASE WHEN null_pct > 20 OR coalesce(k, 0) <= 1 OR k > 10 OR share < 0.01 THEN false ELSE true END AS valid,
       CASE WHEN null_pct > 20 THEN 'too_many_nulls' WHEN coalesce(k, 0) <= 1 THEN 'single_class'
            WHEN k > 10 THEN 'too_many_classes' WHEN share < 0.01 THEN 'rare_class' ELSE 'valid' END AS rule,
       CASE WHEN null_pct > 20 THEN null_pct WHEN coalesce(k, 0) <= 1 OR k > 10 THEN CAST(k AS DOUBLE)
            WHEN share < 0.01 THEN share * 100.0 END AS value,
       null_pct
FROM x"""


@check("v1_target_classification", round_cols=["value", "null_pct"], sql=_sql_target_class("lineitem", "l_returnflag"))
def v1c(spark, sf):
    return V.validate_target(table(spark, sf, "lineitem"), "l_returnflag", "clasificacion")


@check("v1_target_too_many_classes", round_cols=["value", "null_pct"], sql=_sql_target_class("customer", "c_nationkey"))
def v1k(spark, sf):
    return V.validate_target(table(spark, sf, "customer"), "c_nationkey", "clasificacion")


@check("v1_target_dirty_classes", fixtures=["dirty_orders"], round_cols=["value", "null_pct"],
       sql=_sql_target_class("dirty_orders", "o_orderpriority"))
def v1d(spark, sf):
    return V.validate_target(table(spark, sf, "dirty_orders"), "o_orderpriority", "clasificacion")


@check("v1_target_regression", fixtures=["dirty_orders"], round_cols=["value", "null_pct"], sql="""
WITH x AS (SELECT CAST(count(*) FILTER (WHERE o_totalprice IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS null_pct,
                  min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM dirty_orders)
SELECT CASE WHEN null_pct > 20 OR mn IS NULL OR mn = mx THEN false ELSE true END AS valid,
       CASE WHEN null_pct > 20 THEN 'too_many_nulls' WHEN mn IS NULL OR mn = mx THEN 'constant' ELSE 'valid' END AS rule,
       CASE WHEN null_pct > 20 THEN null_pct END AS value, null_pct FROM x""")
def v1r(spark, sf):
    return V.validate_target(table(spark, sf, "dirty_orders"), "o_totalprice", "regresion")


@check("v2_structure", round_cols=["value", "null_pct"], sql=f"""
SELECT valid AND false AS valid, CASE WHEN valid THEN 'missing_predictor:no_such_predictor' ELSE rule END AS rule,
       value, null_pct FROM ({_sql_target_class('lineitem', 'l_returnflag')}) AS t""")
def v2(spark, sf):
    return V.validate_structure(table(spark, sf, "lineitem"), {
        "tipo_problema": "clasificacion", "variable_objetivo": "l_returnflag",
        "variables_predictoras": ["l_quantity", "no_such_predictor"]})


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check("v3_categorical_numeric", round_cols=["ratio"], sql=sql_union([f"""
SELECT '{c}' AS col_name, count(DISTINCT {c}) AS n_distinct,
       CAST(count(DISTINCT {c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS ratio,
       count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) <= 10 AND CAST(count(DISTINCT {c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) < 0.05 AS flagged
FROM lineitem""" for c in LI_NUM]))
def v3(spark, sf):
    return V.categorical_numeric_columns(table(spark, sf, "lineitem"))


def _sql_possible_date(v: str) -> str:
    pref = "regexp_matches(" + v + ", '(?i)^(?:" + "|".join(DATE_LIKE_PREFIXES) + ")')"
    parsed = " OR ".join(f"try_strptime({v}, '{f}') IS NOT NULL" for f in DATE_LIKE_FORMATS)
    return f"(coalesce({pref}, false) OR {parsed})"


TD_COLS = ["d_iso", "d_dmy", "d_ymd", "d_mixed", "d_mostly_iso"]
TN_COLS = ["qty_text", "qty_plain", "price_text"]


def _sql_text_suggest(t: str, cols: list[str]) -> str:
    return sql_union([f"""
SELECT '{c}' AS col_name, n, n_numeric, n_date, n > 0 AND n = n_rows AND n_numeric = n AS numeric_text,
       n > 0 AND n_date >= n * 1.0 AS date_text
FROM (SELECT count(*) AS n_rows, count({c}) AS n, count(*) FILTER (WHERE regexp_matches({c}, '{STRICT_NUMBER}')) AS n_numeric,
             count(*) FILTER (WHERE {c} IS NOT NULL AND {_sql_possible_date(c)}) AS n_date FROM {t}) AS a""" for c in cols])


@check("v4_v5_text_suggestions_numbers", fixtures=["text_numbers"], sql=_sql_text_suggest("text_numbers", TN_COLS))
def v45n(spark, sf):
    return V.text_type_suggestions(table(spark, sf, "text_numbers").select(*TN_COLS))


@check("v4_v5_text_suggestions_dates", fixtures=["text_dates"], sql=_sql_text_suggest("text_dates", TD_COLS))
def v45d(spark, sf):
    return V.text_type_suggestions(table(spark, sf, "text_dates").select(*TD_COLS))


@check("v6_possible_date_rows", fixtures=["text_dates"], sql=f"""
SELECT o_orderkey, d_mixed, {_sql_possible_date('d_mixed')} AS possible_date FROM text_dates""")
def v6(spark, sf):
    df = table(spark, sf, "text_dates")
    return df.select("o_orderkey", "d_mixed", V.possible_date(df["d_mixed"]).alias("possible_date"))


def _sql_date_rules(t: str, c: str, as_of: str) -> str:
    return f"""
WITH a AS (SELECT count(*) AS total, count({c}) AS valid, count(DISTINCT {c}) AS n_unique,
                  CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0) AS BIGINT) AS range_days,
                  count(*) FILTER (WHERE {c} > TIMESTAMP '{as_of}') AS n_future FROM {t}),
     b AS (SELECT *, total - valid AS nulls FROM a)
SELECT '{c}' AS col_name, 'too_many_invalid' AS rule, CAST(nulls AS DOUBLE) AS value FROM b WHERE nulls > total * 0.2
UNION ALL SELECT '{c}', 'not_convertible', CAST(nulls AS DOUBLE) FROM b WHERE nulls = total
UNION ALL SELECT '{c}', 'all_unique', CAST(n_unique AS DOUBLE) FROM b WHERE nulls < total AND n_unique = total - nulls
UNION ALL SELECT '{c}', 'low_range', CAST(range_days AS DOUBLE) FROM b WHERE nulls < total AND range_days < 2
UNION ALL SELECT '{c}', 'mostly_future', CAST(n_future AS DOUBLE) FROM b WHERE nulls < total AND n_future > total * 0.5
UNION ALL SELECT '{c}', 'valid_derive_parts', CAST(range_days AS DOUBLE) FROM b
  WHERE nulls < total AND nulls < total * 0.2 AND n_unique < total * 0.9 AND range_days >= 2"""


@check("v8_date_rules_orders", sql=_sql_date_rules("orders", "o_orderdate", "1998-01-01"))
def v8(spark, sf):
    return V.date_rules(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), as_of="1998-01-01")


@check("v8_date_rules_events", sql=_sql_date_rules("events", "ts", "2025-01-01"))
def v8e(spark, sf):
    return V.date_rules(table(spark, sf, "events"), ["ts"], as_of="2025-01-01")


@check("v9_training_date_columns", fixtures=["text_dates"], sql=sql_union([f"""
SELECT '{c}' AS col_name, coalesce(avg(CASE WHEN regexp_matches({c}, '^(?:{V.TRAINING_DATE_REGEX})') THEN 1.0 ELSE 0.0 END) >= 0.5, false) AS is_date
FROM text_dates WHERE {c} IS NOT NULL""" for c in TD_COLS]))
def v9(spark, sf):
    return V.training_date_columns(table(spark, sf, "text_dates"), ["o_orderkey"])


def _sql_problem_type(t: str, c: str, numeric: bool) -> str:
    kind = ("CASE WHEN CAST(nd AS DOUBLE) / CAST(n AS DOUBLE) < 0.05 OR nd < 10 THEN 'clasificacion' ELSE 'regresion' END"
            if numeric else "'clasificacion'")
    return f"""
SELECT '{c}' AS col_name, {kind} AS problem_type, nd AS n_distinct, CAST(nd AS DOUBLE) / CAST(n AS DOUBLE) AS ratio
FROM (SELECT count(*) AS n, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nd
      FROM {t}) AS a"""


@check("v10_problem_type", fixtures=["dirty_orders"], round_cols=["ratio"], sql=sql_union([
    _sql_problem_type("dirty_orders", "o_totalprice", True), _sql_problem_type("dirty_orders", "o_custkey", True),
    _sql_problem_type("dirty_orders", "o_orderpriority", False)]))
def v10(spark, sf):
    df = table(spark, sf, "dirty_orders")
    return V.problem_type(df, "o_totalprice").unionByName(V.problem_type(df, "o_custkey")) \
        .unionByName(V.problem_type(df, "o_orderpriority"))


@check("v10_problem_type_labels", sql=_sql_problem_type("lineitem", "l_linenumber", True), round_cols=["ratio"])
def v10l(spark, sf):
    return V.problem_type(table(spark, sf, "lineitem"), "l_linenumber")


@check("v11_categorical_for_plots", sql="""
SELECT 'l_tax' AS col_name, count(DISTINCT l_tax) AS n_distinct, count(DISTINCT l_tax) < 10 AS categorical FROM lineitem
UNION ALL
SELECT 'l_returnflag', count(DISTINCT l_returnflag), true FROM lineitem""")
def v11(spark, sf):
    df = table(spark, sf, "lineitem")
    return V.categorical_for_plots(df, "l_tax").unionByName(V.categorical_for_plots(df, "l_returnflag"))


@check("v7_date_candidates", sql="""
SELECT 'l_shipdate' AS col_name, count(*) AS n FROM lineitem UNION ALL SELECT 'o_orderdate', count(*) FROM orders""")
def v7(spark, sf):
    out = []
    for t in ("lineitem", "orders"):
        df = table(spark, sf, t)
        rows = F.array(*[F.struct(F.lit(c).alias("col_name")) for c in V.date_candidates(df)])
        out.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(rows), "n"))
    return out[0].unionByName(out[1])
