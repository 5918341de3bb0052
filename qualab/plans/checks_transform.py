"""Checked queries for column transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from qualab.functions.parsing import DATE_FORMATS, STRICT_NUMBER
from qualab.operators import transform as X
from qualab.plans.fixtures import table
from qualab.plans.registry import check


def _strict(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '{STRICT_NUMBER}') THEN TRY_CAST(trim({v}) AS DOUBLE) END"


def _tn(spark, sf):
    return table(spark, sf, "text_numbers").select("l_orderkey", "l_linenumber", "qty_text", "qty_plain", "price_text")


@check("t1_to_int_auto", fixtures=["text_numbers"], sql=f"""
SELECT l_orderkey, l_linenumber, CASE WHEN d = floor(d) THEN TRY_CAST(d AS BIGINT) END AS qty_text
FROM (SELECT l_orderkey, l_linenumber, {_strict('qty_text')} AS d FROM text_numbers) AS t""")
def t1(spark, sf):
    return X.correct_type(_tn(spark, sf), "qty_text", "int", "auto").select("l_orderkey", "l_linenumber", "qty_text")


@check("t2_to_int_force", fixtures=["text_numbers"], sql="""
SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_extract(qty_text, '(\\d+)', 1) AS BIGINT) AS qty_text FROM text_numbers""")
def t2(spark, sf):
    return X.correct_type(_tn(spark, sf), "qty_text", "int", "force").select("l_orderkey", "l_linenumber", "qty_text")


@check("t3_to_float_auto", fixtures=["text_numbers"], round_cols=["qty_text"], sql=f"""
SELECT l_orderkey, l_linenumber, {_strict('qty_text')} AS qty_text FROM text_numbers""")
def t3(spark, sf):
    return X.correct_type(_tn(spark, sf), "qty_text", "float", "auto").select("l_orderkey", "l_linenumber", "qty_text")


@check("t4_to_float_force", fixtures=["text_numbers"], round_cols=["qty_text"], sql="""
SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_extract(qty_text, '([-+]?\\d*\\.\\d+|\\d+)', 1) AS DOUBLE) AS qty_text
FROM text_numbers""")
def t4(spark, sf):
    return X.correct_type(_tn(spark, sf), "qty_text", "float", "force").select("l_orderkey", "l_linenumber", "qty_text")


@check("t5_to_str", sql="SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders")
def t5(spark, sf):
    return X.correct_type(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "str")


@check("t6_to_bool_standard", fixtures=["bool_text"], sql="""
SELECT o_orderkey, coalesce(length(flag_text) > 0, false) AS flag_text FROM bool_text""")
def t6(spark, sf):
    return X.correct_type(table(spark, sf, "bool_text").select("o_orderkey", "flag_text"), "flag_text", "bool")


@check("t7_to_bool_infer", fixtures=["bool_text"], sql="""
SELECT o_orderkey, CASE WHEN lower(trim(flag_text)) IN ('true', 'yes', 'si', 'verdadero', 'y', 's', 't', '1') THEN true
                        WHEN lower(trim(flag_text)) IN ('false', 'no', 'falso', 'n', 'f', '0') THEN false END AS flag_text
FROM bool_text""")
def t7(spark, sf):
    return X.correct_type(table(spark, sf, "bool_text").select("o_orderkey", "flag_text"), "flag_text", "bool", "infer")


@check("t9_simple_cast_numeric", fixtures=["text_numbers"], round_cols=["price_text"], sql=f"""
SELECT l_orderkey, l_linenumber, {_strict('price_text')} AS price_text FROM text_numbers""")
def t9(spark, sf):
    return X.simple_cast(_tn(spark, sf).select("l_orderkey", "l_linenumber", "price_text"), "price_text", "numerico")


def _sql_date_choice(t: str, v: str, out: str, key: str = "o_orderkey") -> str:
    """Oracle for T10: same choice rule written in DuckDB."""
    fs = DATE_FORMATS
    counts = ", ".join(f"count(try_strptime({v}, '{f}')) AS f{i}" for i, f in enumerate(fs))
    firsts = " ".join(f"WHEN n - f{i} < n * 0.3 THEN {i}" for i in range(len(fs)))
    g = f"greatest({', '.join(f'f{i}' for i in range(len(fs)))})"
    best = " ".join(f"WHEN f{i} = {g} THEN {i}" for i in range(len(fs)))
    parse = " ".join(f"WHEN {i} THEN try_strptime({v}, '{f}')" for i, f in enumerate(fs))
    return f"""
WITH s AS (SELECT count(*) AS n, count(TRY_CAST({v} AS TIMESTAMP)) AS d, {counts} FROM {t}),
     k AS (SELECT CASE WHEN n - d <= n * 0.3 THEN -1 {firsts} ELSE (CASE {best} END) END AS k FROM s)
SELECT {key}, strftime(CASE k WHEN -1 THEN TRY_CAST({v} AS TIMESTAMP) {parse} END, '{out}') AS {v}
FROM {t}, k"""


@check("t10_dates_dmy_to_iso", fixtures=["text_dates"], sql=_sql_date_choice("text_dates", "d_dmy", "%Y-%m-%d"))
def t10(spark, sf):
    return X.standardize_dates(table(spark, sf, "text_dates").select("o_orderkey", "d_dmy"), "d_dmy", "ISO")


@check("t10_dates_mixed_to_iso", fixtures=["text_dates"], sql=_sql_date_choice("text_dates", "d_mixed", "%Y-%m-%d"))
def t10m(spark, sf):
    return X.standardize_dates(table(spark, sf, "text_dates").select("o_orderkey", "d_mixed"), "d_mixed", "ISO")


@check("t10_dates_iso_to_dmy", fixtures=["text_dates"],
       sql=_sql_date_choice("text_dates", "d_mostly_iso", "%d/%m/%Y"))
def t10d(spark, sf):
    return X.standardize_dates(table(spark, sf, "text_dates").select("o_orderkey", "d_mostly_iso"), "d_mostly_iso", "DMY")


@check("t11_dates_by_pattern", fixtures=["text_dates"], sql="""
SELECT o_orderkey, try_strptime(d_ymd, '%Y/%m/%d') AS d_ymd, d_mixed FROM text_dates""")
def t11(spark, sf):
    df = table(spark, sf, "text_dates").select("o_orderkey", "d_ymd", "d_mixed")
    return X.standardize_dates_by_pattern(X.standardize_dates_by_pattern(df, "d_ymd"), "d_mixed")


@check("t12_date_parts", sql="""
SELECT o_orderkey, o_orderdate,
       CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_anio, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_mes,
       CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_dia, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dia_semana,
       dayname(o_orderdate) AS o_orderdate_nombre_dia, monthname(o_orderdate) AS o_orderdate_nombre_mes,
       CAST(dayofyear(o_orderdate) AS INTEGER) AS o_orderdate_dia_anio, CAST(weekofyear(o_orderdate) AS INTEGER) AS o_orderdate_semana,
       coalesce(isodow(o_orderdate) - 1 >= 5, false) AS o_orderdate_es_fin_de_semana,
       CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate_fecha_epoch
FROM orders""")
def t12(spark, sf):
    return X.date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@check("t13_expand_dates", round_cols=["o_totalprice"], sql="""
SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_anio,
       CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_mes, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_dia
FROM orders""")
def t13(spark, sf):
    return X.expand_dates(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))


@check("t14_convert_units_dominant", fixtures=["units"], round_cols=["weight_text_value"], sql="""
SELECT l_orderkey, l_linenumber, CAST(v AS VARCHAR) || ' kg' AS weight_text, v AS weight_text_value,
       CASE WHEN v IS NOT NULL THEN 'kg' END AS weight_text_unit
FROM (SELECT l_orderkey, l_linenumber,
             TRY_CAST(regexp_extract(weight_text, '(-?\\d+\\.?\\d*)', 1) AS DOUBLE) * CAST(0.001 AS DOUBLE) AS v
      FROM units) AS u""")
def t14(spark, sf):
    df = table(spark, sf, "units").select("l_orderkey", "l_linenumber", "weight_text")
    return X.convert_units(df, "weight_text", "kg")


@check("t14_convert_units_per_row", fixtures=["units"], round_cols=["weight_text_value"], sql="""
SELECT l_orderkey, l_linenumber, CAST(v AS VARCHAR) || ' kg' AS weight_text, v AS weight_text_value,
       CASE WHEN v IS NOT NULL THEN 'kg' END AS weight_text_unit
FROM (SELECT l_orderkey, l_linenumber,
             CASE regexp_extract(weight_text, '(-?\\d+\\.?\\d*)\\s*([a-zA-Z°]+)', 2)
                  WHEN 'kg' THEN TRY_CAST(regexp_extract(weight_text, '(-?\\d+\\.?\\d*)', 1) AS DOUBLE)
                  WHEN 'g' THEN TRY_CAST(regexp_extract(weight_text, '(-?\\d+\\.?\\d*)', 1) AS DOUBLE) * CAST(0.001 AS DOUBLE)
                  WHEN 'lb' THEN TRY_CAST(regexp_extract(weight_text, '(-?\\d+\\.?\\d*)', 1) AS DOUBLE) * CAST(0.454 AS DOUBLE)
             END AS v
      FROM units) AS u""")
def t14r(spark, sf):
    df = table(spark, sf, "units").select("l_orderkey", "l_linenumber", "weight_text")
    return X.convert_units(df, "weight_text", "kg", mode="per_row")


@check("t15_dominant_unit", fixtures=["units"], sql="""
SELECT unit, count(*) AS count FROM (
  SELECT regexp_extract(weight_text, '(-?\\d+\\.?\\d*)\\s*([a-zA-Z°]+)', 2) AS unit FROM units) AS u
WHERE unit <> '' GROUP BY unit ORDER BY count(*) DESC, unit LIMIT 1""")
def t15(spark, sf):
    return X.dominant_unit(table(spark, sf, "units"), "weight_text")


@check("t16_numeric_units", fixtures=["units"], round_cols=["temp_c"], sql="""
SELECT l_orderkey, l_linenumber, temp_c * 9 / 5 + 32 AS temp_c FROM units""")
def t16(spark, sf):
    df = table(spark, sf, "units").select("l_orderkey", "l_linenumber", "temp_c")
    return X.convert_numeric_units(df, "temp_c", "fahrenheit")


@check("t17_apply_corrections", fixtures=["text_numbers"], round_cols=["price_text"], sql=f"""
SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_extract(qty_text, '(\\d+)', 1) AS BIGINT) AS qty_text,
       CASE WHEN lower(trim(qty_plain)) IN ('true', 'yes', 'si', 'verdadero', 'y', 's', 't', '1') THEN true
            WHEN lower(trim(qty_plain)) IN ('false', 'no', 'falso', 'n', 'f', '0') THEN false END AS qty_plain,
       {_strict('price_text')} AS price_text
FROM text_numbers""")
def t17(spark, sf):
    out, _ = X.apply_corrections(_tn(spark, sf), [("qty_text", "int", "force"), ("no_such_column", "int", "auto"),
                                                  ("qty_plain", "bool", "infer"), ("price_text", "float", "auto"),
                                                  ("qty_text", "Convertir a categórica", "auto")])
    return out


@check("t8_to_datetime_iso", fixtures=["text_dates"], sql=_sql_date_choice("text_dates", "d_ymd", "%Y-%m-%d"))
def t8(spark, sf):
    return X.correct_type(table(spark, sf, "text_dates").select("o_orderkey", "d_ymd"), "d_ymd", "datetime")
