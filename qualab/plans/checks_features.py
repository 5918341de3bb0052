"""Checked queries for feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualab.operators import features as FE
from qualab.plans.fixtures import table
from qualab.plans.registry import check

LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def sql_hash_unit(key_sql: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5('{seed}|' || {key_sql}), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"


def sql_row_key(cols: list[str]) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)


def _prep_sql() -> str:
    status = ["O", "P"]
    prio = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cols = {
        "o_orderkey": "CAST(o_orderkey AS DOUBLE)", "o_custkey": "CAST(o_custkey AS DOUBLE)",
        "o_totalprice": "CAST(o_totalprice AS DOUBLE)",
        "o_orderdate_anio": "CAST(year(o_orderdate) AS DOUBLE)", "o_orderdate_mes": "CAST(month(o_orderdate) AS DOUBLE)",
        "o_orderdate_dia": "CAST(day(o_orderdate) AS DOUBLE)",
    }
    for v in status:
        cols[f"o_orderstatus_{v}"] = f"CAST(coalesce(CAST(o_orderstatus = '{v}' AS INTEGER), 0) AS DOUBLE)"
    cols["o_orderstatus_nan"] = "CAST(CAST(o_orderstatus IS NULL AS INTEGER) AS DOUBLE)"
    for v in prio:
        cols[f"o_orderpriority_{v}"] = f"CAST(coalesce(CAST(o_orderpriority = '{v}' AS INTEGER), 0) AS DOUBLE)"
    cols["o_orderpriority_nan"] = "CAST(CAST(o_orderpriority IS NULL AS INTEGER) AS DOUBLE)"
    inner = ", ".join(f'{e} AS "{k}"' for k, e in cols.items())
    outer = ", ".join(f'coalesce("{k}", avg("{k}") OVER (), 0.0) AS "{k}"' for k in cols)
    return f"SELECT {outer} FROM (SELECT {inner} FROM dirty_orders) AS b"


@check("f1_prepare_for_ml", fixtures=["dirty_orders"], sql=_prep_sql(), round_cols=[
    "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate_anio", "o_orderdate_mes", "o_orderdate_dia"])
def f1(spark, sf):
    return FE.prepare_for_ml(table(spark, sf, "dirty_orders"))


@check("f2_cap_categories", sql="""
WITH c AS (SELECT p_type, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY p_type),
     t AS (SELECT p_type FROM c ORDER BY n DESC, p_type LIMIT 10)
SELECT p_partkey, CASE WHEN (SELECT count(*) FROM c) <= 10 OR p_type IN (SELECT p_type FROM t) THEN p_type
                       ELSE 'OTROS' END AS p_type
FROM part""")
def f2(spark, sf):
    return FE.cap_categories(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


@check("f3_one_hot", round_cols=["l_quantity"], sql="""
SELECT l_quantity, coalesce(CAST(l_returnflag = 'N' AS INTEGER), 0) AS l_returnflag_N,
       coalesce(CAST(l_returnflag = 'R' AS INTEGER), 0) AS l_returnflag_R,
       CAST(l_returnflag IS NULL AS INTEGER) AS l_returnflag_nan,
       coalesce(CAST(l_linestatus = 'O' AS INTEGER), 0) AS l_linestatus_O,
       CAST(l_linestatus IS NULL AS INTEGER) AS l_linestatus_nan
FROM lineitem""")
def f3(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    return FE.one_hot(FE.one_hot(df, "l_returnflag"), "l_linestatus")


@check("f5_impute_mean", fixtures=["dirty_orders"], round_cols=["o_custkey", "o_totalprice"], sql="""
SELECT o_orderkey, coalesce(CAST(o_custkey AS DOUBLE), avg(o_custkey) OVER (), 0.0) AS o_custkey,
       coalesce(o_totalprice, avg(o_totalprice) OVER (), 0.0) AS o_totalprice
FROM dirty_orders""")
def f5(spark, sf):
    df = table(spark, sf, "dirty_orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return FE.impute_mean(FE.finite_or_null(df), columns=["o_custkey", "o_totalprice"])


@check("f7_hash_split", sql=f"""
SELECT o_orderkey, {sql_hash_unit('CAST(o_orderkey AS VARCHAR)')} < 0.2 AS is_test FROM orders""")
def f7(spark, sf):
    return FE.split_flag(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.2)


@check("f7_hash_split_share", round_cols=["test_share"], sql=f"""
SELECT count(*) AS n_rows, CAST(count(*) FILTER (WHERE {sql_hash_unit(sql_row_key(LI_ALL))} < 0.2) AS DOUBLE)
       / CAST(count(*) AS DOUBLE) AS test_share FROM lineitem""")
def f7s(spark, sf):
    s = FE.split_flag(table(spark, sf, "lineitem"), LI_ALL, 0.2)
    return s.agg(F.count(F.lit(1)).alias("n_rows"), (F.count_if("is_test") / F.count(F.lit(1))).alias("test_share"))


SC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check("f8_standard_scaling", round_cols=SC, sql=f"""
WITH s AS (SELECT l_orderkey, l_linenumber, {', '.join(SC)},
                  {sql_hash_unit(sql_row_key(LI_ALL))} < 0.2 AS is_test FROM lineitem),
     f AS (SELECT {', '.join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in SC)}
           FROM s WHERE NOT is_test)
SELECT l_orderkey, l_linenumber, is_test, {', '.join(f"({c} - m_{c}) / s_{c} AS {c}" for c in SC)} FROM s, f""")
def f8(spark, sf):
    df = FE.split_flag(table(spark, sf, "lineitem"), LI_ALL, 0.2)
    scaler = FE.fit_scaler(df.where(~F.col("is_test")), SC)
    return FE.apply_scaler(df, scaler).select("l_orderkey", "l_linenumber", "is_test", *SC)


@check("f9_label_encoding", sql="""
SELECT l_orderkey, l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS label FROM lineitem""")
def f9(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    return FE.encode_labels(df, "l_returnflag", FE.fit_labels(df, "l_returnflag"))


@check("p1_p2_select_predictors", round_cols=["l_quantity", "l_discount"], sql="""
SELECT l_quantity, l_discount FROM lineitem""")
def p12(spark, sf):
    df = table(spark, sf, "lineitem")
    x, _ = FE.split_target(df, "l_returnflag")
    return FE.select_predictors(x, ["l_quantity", "l_discount", "l_returnflag", "nope"], "l_returnflag")


@check("p5_drop_all_null_columns", fixtures=["dirty_orders"], round_cols=["o_totalprice"],
       sql="SELECT * FROM dirty_orders")
def p5(spark, sf):
    df = table(spark, sf, "dirty_orders").withColumn("empty_col", F.lit(None).cast("double"))
    return FE.drop_all_null_columns(df)


@check("j1_append_columns", round_cols=["net"], sql="""
SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_returnflag = 'R' AS returned FROM lineitem""")
def j1(spark, sf):
    df = table(spark, sf, "lineitem")
    out = FE.append_columns(df, {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
                                 "returned": F.col("l_returnflag") == "R"})
    return out.select("l_orderkey", "net", "returned")


# --------------------------------------------------------------------------- P3, P4, F4, F6
@check("p3_candidate_targets", sql="""
SELECT 'regresion' AS problem_type, c AS col_name, (SELECT count(*) FROM orders) AS n
FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) AS t(c)
UNION ALL
SELECT 'clasificacion', c, (SELECT count(*) FROM orders)
FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) AS t(c)""")
def p3(spark, sf):
    df = table(spark, sf, "orders")
    names = [(kind, c) for kind in ("regresion", "clasificacion") for c in FE.candidate_targets(df, kind)]
    rows = F.array(*[F.struct(F.lit(k).alias("problem_type"), F.lit(c).alias("col_name")) for k, c in names])
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(rows), "n")


@check("p4_align_columns", round_cols=["c_acctbal"], sql="""
SELECT c_acctbal, CAST(NULL AS DOUBLE) AS c_extra, c_custkey FROM customer""")
def p4(spark, sf):
    return FE.align_columns(table(spark, sf, "customer"), ["c_acctbal", "c_extra", "c_custkey"])[0]


@check("f4_numeric_only", round_cols=["value"], sql="SELECT event_id, user_id, value FROM events")
def f4(spark, sf):
    return FE.numeric_only(table(spark, sf, "events"))


@check("f6_finite_or_null", round_cols=["x", "y"], sql="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS x,
       CASE WHEN l_tax > 0 THEN l_extendedprice END AS y FROM lineitem""")
def f6(spark, sf):
    li = table(spark, sf, "lineitem")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    x = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.when(F.col("l_tax") > 0.04, inf).otherwise(-inf))
    y = F.when(F.col("l_tax") > 0, F.col("l_extendedprice")).otherwise(nan)
    return FE.finite_or_null(li.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y")))
