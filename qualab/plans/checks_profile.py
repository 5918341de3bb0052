"""Checked queries for profiling."""

from __future__ import annotations

from qualab.operators import profile as P
from qualab.plans.fixtures import table
from qualab.plans.registry import check, sql_long, sql_union

# dirty_orders: columns and their kinds (fixed by the fixture definition)
DO_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
DO_TXT = ["o_orderstatus", "o_orderpriority"]
DO_DT = ["o_orderdate"]
DO_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DO_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
            "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def sql_basic_metrics(t: str, cols: list[str]) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    distinct = " + ".join(f"count(DISTINCT {c})" for c in cols)
    n = len(cols)
    return f"""
SELECT n_rows, CAST({n} AS BIGINT) AS n_columns, null_cells,
       {_d('null_cells')} / {_d(f'n_rows * {n}')} * 100.0 AS null_pct,
       duplicate_rows,
       CASE WHEN n_rows > 0 THEN {_d('duplicate_rows')} / {_d('n_rows')} * 100.0 ELSE 0.0 END AS duplicate_pct,
       mean_distinct,
       100.0 - {_d('null_cells')} / {_d(f'n_rows * {n}')} * 100.0 AS completeness
FROM (SELECT count(*) AS n_rows, CAST({nulls} AS BIGINT) AS null_cells,
             {_d(distinct)} / {_d(str(n))} AS mean_distinct FROM {t}) AS b,
     (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
      FROM (SELECT count(*) AS c FROM {t} GROUP BY {', '.join(cols)}) AS g) AS d"""


def sql_outliers_iqr(t: str, num: list[str], k: float = 1.5) -> str:
    long = sql_long(t, {c: _d(c) for c in num})
    return f"""
SELECT col_name, 'iqr' AS method, CAST({k} AS DOUBLE) AS threshold, n, outliers,
       {_d('outliers')} / {_d('n')} * 100.0 AS outlier_pct, q1, q3, iqr,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, lower, upper
FROM (
  SELECT b.col_name, b.n, b.q1, b.q3, b.iqr, b.lower, b.upper,
         count(*) FILTER (WHERE l.value < b.lower OR l.value > b.upper) AS outliers
  FROM (SELECT col_name, n, q1, q3, q3 - q1 AS iqr, q1 - CAST({k} AS DOUBLE) * (q3 - q1) AS lower,
               q3 + CAST({k} AS DOUBLE) * (q3 - q1) AS upper
        FROM (SELECT col_name, count(value) AS n, quantile_cont(value, 0.25) AS q1,
                     quantile_cont(value, 0.75) AS q3
              FROM ({long}) AS x WHERE value IS NOT NULL GROUP BY col_name) AS s
        WHERE n > 1) AS b
  JOIN ({long}) AS l ON l.col_name = b.col_name AND l.value IS NOT NULL
  GROUP BY b.col_name, b.n, b.q1, b.q3, b.iqr, b.lower, b.upper) AS r"""


def sql_outliers_moment(t: str, num: list[str], method: str, k: float) -> str:
    long = sql_long(t, {c: _d(c) for c in num})
    if method == "zscore":
        cond = f"coalesce(abs((l.value - b.mean) / nullif(b.std, 0)) > CAST({k} AS DOUBLE), false)"
    else:
        cond = "(l.value < b.lower OR l.value > b.upper)"
    return f"""
SELECT col_name, '{method}' AS method, CAST({k} AS DOUBLE) AS threshold, n, outliers,
       {_d('outliers')} / {_d('n')} * 100.0 AS outlier_pct,
       CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS iqr, mean, std, lower, upper
FROM (
  SELECT b.col_name, b.n, b.mean, b.std, b.lower, b.upper, count(*) FILTER (WHERE {cond}) AS outliers
  FROM (SELECT col_name, n, mean, std, mean - CAST({k} AS DOUBLE) * std AS lower,
               mean + CAST({k} AS DOUBLE) * std AS upper
        FROM (SELECT col_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std
              FROM ({long}) AS x WHERE value IS NOT NULL GROUP BY col_name) AS s
        WHERE n > 1) AS b
  JOIN ({long}) AS l ON l.col_name = b.col_name AND l.value IS NOT NULL
  GROUP BY b.col_name, b.n, b.mean, b.std, b.lower, b.upper) AS r"""


OUTLIER_ROUND = ["threshold", "outlier_pct", "q1", "q3", "iqr", "mean", "std", "lower", "upper"]
BASIC_ROUND = ["null_pct", "duplicate_pct", "mean_distinct", "completeness"]


@check("a1_basic_metrics", fixtures=["dirty_orders"], round_cols=BASIC_ROUND,
       sql=sql_basic_metrics("dirty_orders", DO_ALL))
def a1(spark, sf):
    return P.basic_metrics(table(spark, sf, "dirty_orders"))


@check("a1_basic_metrics_dup", fixtures=["dup_orders"], round_cols=BASIC_ROUND,
       sql=sql_basic_metrics("dup_orders", DO_ALL))
def a1_dup(spark, sf):
    return P.basic_metrics(table(spark, sf, "dup_orders").drop("seq"))


def sql_nulls_by_column(t: str, cols: list[str]) -> str:
    branches = sql_union([f"SELECT '{c}' AS col_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                          f"count(*) AS n FROM {t}" for c in cols])
    return f"""
SELECT col_name, nulls, pct, 100.0 - pct AS completeness,
       CASE WHEN pct > 0 AND pct <= 5 THEN 'Excelente' WHEN pct > 5 AND pct <= 20 THEN 'Buena'
            WHEN pct > 20 AND pct <= 50 THEN 'Regular' WHEN pct > 50 AND pct <= 100 THEN 'Crítica' END AS null_class
FROM (SELECT col_name, nulls, {_d('nulls')} / {_d('n')} * 100.0 AS pct FROM ({branches}) AS b) AS x"""


@check("a2_nulls_by_column", fixtures=["dirty_orders"], round_cols=["pct", "completeness"],
       sql=sql_nulls_by_column("dirty_orders", DO_ALL))
def a2(spark, sf):
    return P.nulls_by_column(table(spark, sf, "dirty_orders"))


@check("a3_null_table", fixtures=["dirty_orders"], round_cols=["pct", "completeness"],
       sql=f"""SELECT col_name, nulls, round(pct, 2) AS pct, round(completeness, 2) AS completeness, null_class
FROM ({sql_nulls_by_column('dirty_orders', DO_ALL)}) AS a WHERE nulls > 0""")
def a3(spark, sf):
    return P.null_table(table(spark, sf, "dirty_orders"))


@check("a4_empty_rows", fixtures=["dirty_orders"],
       sql="SELECT count(*) FILTER (WHERE " + " AND ".join(f"{c} IS NULL" for c in
                                                           [c for c in DO_ALL if c != "o_orderkey"])
           + ") AS empty_rows FROM dirty_orders")
def a4(spark, sf):
    return P.empty_rows(table(spark, sf, "dirty_orders").drop("o_orderkey"))


@check("a6_outliers_iqr", fixtures=["dirty_orders"], round_cols=OUTLIER_ROUND,
       sql=sql_outliers_iqr("dirty_orders", DO_NUM))
def a6(spark, sf):
    return P.outliers(table(spark, sf, "dirty_orders"), "iqr", 1.5)


@check("a6_outliers_iqr_lineitem", round_cols=OUTLIER_ROUND,
       sql=sql_outliers_iqr("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                         "l_extendedprice", "l_discount", "l_tax"]))
def a6_li(spark, sf):
    return P.outliers(table(spark, sf, "lineitem"), "iqr", 1.5)


@check("a7_outliers_zscore", fixtures=["dirty_orders"], round_cols=OUTLIER_ROUND,
       sql=sql_outliers_moment("dirty_orders", DO_NUM, "zscore", 3.0))
def a7(spark, sf):
    return P.outliers(table(spark, sf, "dirty_orders"), "zscore", 3.0)


@check("a8_outliers_deviation", fixtures=["dirty_orders"], round_cols=OUTLIER_ROUND,
       sql=sql_outliers_moment("dirty_orders", DO_NUM, "deviation", 2.0))
def a8(spark, sf):
    return P.outliers(table(spark, sf, "dirty_orders"), "deviation", 2.0)


@check("a9_outlier_rows", fixtures=["dirty_orders"], round_cols=["value"],
       sql=f"""
SELECT l.o_orderkey, l.col_name, l.value
FROM ({sql_long('dirty_orders', {c: _d(c) for c in DO_NUM}, ids=['o_orderkey'])}) AS l
JOIN ({sql_outliers_iqr('dirty_orders', DO_NUM)}) AS b ON l.col_name = b.col_name
WHERE l.value < b.lower OR l.value > b.upper""")
def a9(spark, sf):
    return P.outlier_rows(table(spark, sf, "dirty_orders"), ["o_orderkey"], "iqr", 1.5)


@check("a10_duplicate_groups", fixtures=["dup_orders"],
       sql="""SELECT o_custkey, o_orderstatus, count(*) AS size FROM dup_orders
GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1""")
def a10(spark, sf):
    return P.duplicate_groups(table(spark, sf, "dup_orders"), ["o_custkey", "o_orderstatus", "not_a_column"])


@check("a10_duplicate_summary", fixtures=["dup_orders"], round_cols=["duplicate_pct"],
       sql="""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates,
       CASE WHEN sum(c) > 0 THEN CAST(sum(c - 1) AS DOUBLE) / CAST(sum(c) AS DOUBLE) * 100.0 ELSE 0.0 END AS duplicate_pct,
       count(*) FILTER (WHERE c > 1) AS n_groups
FROM (SELECT count(*) AS c FROM dup_orders
      GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) AS g""")
def a10s(spark, sf):
    return P.duplicate_summary(table(spark, sf, "dup_orders").drop("seq"))


def sql_column_stats(t: str) -> str:
    branches = []
    for c in DO_ALL:
        typ = DO_TYPES[c]
        kind = "numeric" if c in DO_NUM else "text" if c in DO_TXT else "datetime"
        num = c in DO_NUM
        txt = c in DO_TXT
        dt = c in DO_DT
        nd = "CAST(NULL AS DOUBLE)"
        branches.append(f"""
SELECT '{c}' AS col_name, '{typ}' AS type, '{kind}' AS kind,
       count(*) FILTER (WHERE {c} IS NULL) AS nulls,
       CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS null_pct,
       count(DISTINCT {c}) AS n_distinct,
       {f'min({_d(c)})' if num else nd} AS min, {f'max({_d(c)})' if num else nd} AS max,
       {f'avg({_d(c)})' if num else nd} AS mean, {f'quantile_cont({_d(c)}, 0.5)' if num else nd} AS median,
       {f'stddev_samp({_d(c)})' if num else nd} AS std,
       {f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)" if txt else 'CAST(NULL AS VARCHAR)'} AS top,
       {f"(SELECT count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)" if txt else 'CAST(NULL AS BIGINT)'} AS top_freq,
       {f'avg(length({c}))' if txt else nd} AS mean_length,
       {f'min({c})' if dt else 'CAST(NULL AS TIMESTAMP)'} AS date_min,
       {f'max({c})' if dt else 'CAST(NULL AS TIMESTAMP)'} AS date_max,
       {f'CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0) AS BIGINT)' if dt else 'CAST(NULL AS BIGINT)'} AS range_days
FROM {t}""")
    return sql_union(branches)


@check("a11_column_stats", fixtures=["dirty_orders"],
       round_cols=["null_pct", "min", "max", "mean", "median", "std", "mean_length"],
       sql=sql_column_stats("dirty_orders"))
def a11(spark, sf):
    return P.column_stats(table(spark, sf, "dirty_orders"))


def sql_quality_score(t: str, cols: list[str], num: list[str]) -> str:
    return f"""
SELECT score, CASE WHEN score >= 90 THEN 'Excelente' WHEN score >= 75 THEN 'Buena'
                   WHEN score >= 50 THEN 'Regular' ELSE 'Deficiente' END AS grade,
       score_completeness, score_duplicates, score_outliers, n_rows, n_columns, null_cells, null_pct,
       duplicate_rows, duplicate_pct, mean_distinct, completeness, mean_outlier_pct
FROM (SELECT *, score_completeness + score_duplicates + score_outliers AS score
      FROM (SELECT m.*, coalesce(o.mean_outlier_pct, 0.0) AS mean_outlier_pct,
                   least(40.0, m.completeness * 0.4) AS score_completeness,
                   least(30.0, 30.0 * (1.0 - m.duplicate_pct / 100.0)) AS score_duplicates,
                   least(30.0, 30.0 * (1.0 - coalesce(o.mean_outlier_pct, 0.0) / 100.0)) AS score_outliers
            FROM ({sql_basic_metrics(t, cols)}) AS m,
                 (SELECT avg(outlier_pct) AS mean_outlier_pct FROM ({sql_outliers_iqr(t, num)}) AS oo) AS o) AS s) AS z"""


SCORE_ROUND = ["score", "score_completeness", "score_duplicates", "score_outliers", "null_pct",
               "duplicate_pct", "mean_distinct", "completeness", "mean_outlier_pct"]


@check("a12_quality_score", fixtures=["dirty_orders"], round_cols=SCORE_ROUND,
       sql=sql_quality_score("dirty_orders", DO_ALL, DO_NUM))
def a12(spark, sf):
    return P.quality_score(table(spark, sf, "dirty_orders"))


LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]


@check("a12_quality_score_lineitem", round_cols=SCORE_ROUND, sql=sql_quality_score("lineitem", LI_ALL, LI_NUM))
def a12_li(spark, sf):
    return P.quality_score(table(spark, sf, "lineitem"))


@check("a13_quality_findings", fixtures=["dirty_orders"], round_cols=["value"], sql=f"""
WITH nb AS ({sql_nulls_by_column('dirty_orders', DO_ALL)}),
     oc AS ({sql_outliers_iqr('dirty_orders', DO_NUM)}),
     qs AS ({sql_quality_score('dirty_orders', DO_ALL, DO_NUM)}),
     f AS (
  SELECT 1 AS k, 'warning' AS severity, 'nulls_over_50' AS rule, CAST(count(*) AS DOUBLE) AS value
  FROM nb WHERE pct > 50 HAVING count(*) > 0
  UNION ALL SELECT 2, 'warning', 'nulls_20_50', CAST(count(*) AS DOUBLE) FROM nb WHERE pct > 20 AND pct <= 50 HAVING count(*) > 0
  UNION ALL SELECT 3, 'warning', 'duplicates_over_5', duplicate_pct FROM qs WHERE duplicate_pct > 5
  UNION ALL SELECT 4, 'info', 'outliers_over_5', CAST(count(*) AS DOUBLE) FROM oc WHERE outlier_pct > 5 HAVING count(*) > 0
  UNION ALL SELECT 5, CASE grade WHEN 'Deficiente' THEN 'error' WHEN 'Regular' THEN 'warning'
                              WHEN 'Buena' THEN 'info' ELSE 'success' END, 'grade_' || grade, CAST(NULL AS DOUBLE) FROM qs)
SELECT severity, rule, value FROM f
UNION ALL SELECT 'success', 'no_issues', CAST(NULL AS DOUBLE) WHERE (SELECT count(*) FROM f) <= 1""")
def a13(spark, sf):
    return P.quality_findings(table(spark, sf, "dirty_orders"))


# ----------------------------------------------------------------------------- EDA
@check("a14_numeric_describe", round_cols=["mean", "std", "min", "p25", "p50", "p75", "max"], sql=f"""
SELECT col_name, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       max(value) AS max
FROM ({sql_long('lineitem', {c: _d(c) for c in LI_NUM})}) AS l GROUP BY col_name""")
def a14(spark, sf):
    return P.numeric_describe(table(spark, sf, "lineitem"))


@check("a15_categorical_describe", fixtures=["dirty_orders"], sql=sql_union([f"""
SELECT '{c}' AS col_name, count({c}) AS count, count(DISTINCT {c}) AS "unique",
       (SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
       (SELECT count(*) FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq
FROM dirty_orders""" for c in DO_TXT]))
def a15(spark, sf):
    return P.categorical_describe(table(spark, sf, "dirty_orders"))


@check("a16_value_shares", fixtures=["dirty_orders"], round_cols=["pct"], sql="""
SELECT o_orderpriority AS value, count(*) AS count,
       CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM dirty_orders WHERE o_orderpriority IS NOT NULL) AS DOUBLE) * 100.0 AS pct
FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def a16(spark, sf):
    return P.value_shares(table(spark, sf, "dirty_orders"), "o_orderpriority")


@check("a17_histogram", fixtures=["dirty_orders"], round_cols=["lower", "upper"], sql="""
WITH s AS (SELECT min(o_totalprice) AS lo0, max(o_totalprice) AS hi0 FROM dirty_orders),
     b AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s),
     c AS (SELECT CAST(least(floor((o_totalprice - lo) * (CAST(30 AS DOUBLE) / (hi - lo))), 29) AS BIGINT) AS bin,
                  count(*) AS cnt
           FROM dirty_orders, b WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, lo + g.bin * ((hi - lo) / CAST(30 AS DOUBLE)) AS lower,
       lo + (g.bin + 1) * ((hi - lo) / CAST(30 AS DOUBLE)) AS upper, coalesce(c.cnt, 0) AS count
FROM (SELECT range AS bin FROM range(30)) AS g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""")
def a17(spark, sf):
    return P.histogram(table(spark, sf, "dirty_orders"), "o_totalprice", 30)


@check("a18_density", round_cols=["x", "density"], sql="""
WITH s AS (SELECT count(*) AS n, stddev_samp(l_quantity) AS sd, min(l_quantity) AS mn, max(l_quantity) AS mx
           FROM lineitem WHERE l_quantity IS NOT NULL),
     p AS (SELECT n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM s),
     g AS (SELECT p.n, p.bw, s.mn - CAST(3 AS DOUBLE) * p.bw AS g0,
                  (s.mx + CAST(3 AS DOUBLE) * p.bw - (s.mn - CAST(3 AS DOUBLE) * p.bw)) / CAST(199 AS DOUBLE) AS step
           FROM s, p),
     v AS (SELECT l_quantity AS value, count(*) AS w FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1)
SELECT CAST(i.range AS INTEGER) AS i, g0 + i.range * step AS x,
       sum(w * exp(-0.5 * ((g0 + i.range * step - value) / bw) * ((g0 + i.range * step - value) / bw)))
         / (n * bw * sqrt(2 * pi())) AS density
FROM range(200) AS i, g, v GROUP BY i.range, g0, step, n, bw""")
def a18(spark, sf):
    return P.density(table(spark, sf, "lineitem"), "l_quantity")


@check("a19_crosstab", fixtures=["dirty_orders"], sql="""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P
FROM dirty_orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority""")
def a19(spark, sf):
    return P.crosstab(table(spark, sf, "dirty_orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def sql_box(t: str, v: str, g: str) -> str:
    return f"""
WITH q AS (SELECT {g} AS grp, count({v}) AS n, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
                  quantile_cont({v}, 0.75) AS q3 FROM {t} WHERE {v} IS NOT NULL GROUP BY {g}),
     f AS (SELECT *, q3 - q1 AS iqr, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower_fence,
                  q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper_fence FROM q)
SELECT f.grp AS {g}, n, q1, median, q3, iqr, lower_fence, upper_fence,
       min(CAST(x.{v} AS DOUBLE)) FILTER (WHERE x.{v} >= lower_fence AND x.{v} <= upper_fence) AS whisker_low,
       max(CAST(x.{v} AS DOUBLE)) FILTER (WHERE x.{v} >= lower_fence AND x.{v} <= upper_fence) AS whisker_high,
       count(*) FILTER (WHERE NOT (x.{v} >= lower_fence AND x.{v} <= upper_fence)) AS n_outliers
FROM f JOIN {t} AS x ON x.{g} IS NOT DISTINCT FROM f.grp AND x.{v} IS NOT NULL
GROUP BY f.grp, n, q1, median, q3, iqr, lower_fence, upper_fence"""


BOX_ROUND = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]


@check("a20_box_by_class", round_cols=BOX_ROUND, sql=sql_box("lineitem", "l_extendedprice", "l_returnflag"))
def a20(spark, sf):
    return P.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@check("a20_box_by_category", fixtures=["dirty_orders"], round_cols=BOX_ROUND,
       sql=sql_box("dirty_orders", "o_totalprice", "o_orderpriority"))
def a20b(spark, sf):
    return P.box_stats(table(spark, sf, "dirty_orders"), "o_totalprice", "o_orderpriority")


@check("a21_scatter_points", round_cols=["x", "y"],
       sql="SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem")
def a21(spark, sf):
    return P.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


def sql_skew(t: str, num: list[str]) -> str:
    return f"""
SELECT col_name, n, skew, coalesce(abs(skew) > 1.0, false) AS skewed
FROM (SELECT col_name, count(value) AS n, CASE WHEN count(value) > 2 THEN skewness(value) END AS skew
      FROM ({sql_long(t, {c: _d(c) for c in num})}) AS l GROUP BY col_name) AS s"""


@check("a22_skewness", fixtures=["dirty_orders"], round_cols=["skew"], sql=sql_skew("dirty_orders", DO_NUM))
def a22(spark, sf):
    return P.skewness(table(spark, sf, "dirty_orders"))


@check("a23_target_stats", round_cols=["min", "max", "mean", "std", "range"], sql="""
SELECT min(o_totalprice) AS min, max(o_totalprice) AS max, avg(o_totalprice) AS mean,
       stddev_samp(o_totalprice) AS std, max(o_totalprice) - min(o_totalprice) AS range FROM orders""")
def a23(spark, sf):
    return P.target_stats(table(spark, sf, "orders"), "o_totalprice")


@check("a24_eda_findings", fixtures=["dup_orders"], round_cols=["value"], sql=f"""
WITH m AS ({sql_basic_metrics('dup_orders', DO_ALL)})
SELECT 'has_nulls' AS finding, CAST(NULL AS VARCHAR) AS col_name, CAST(null_cells AS DOUBLE) AS value FROM m WHERE null_cells > 0
UNION ALL SELECT 'has_duplicates', NULL, CAST(duplicate_rows AS DOUBLE) FROM m WHERE duplicate_rows > 0
UNION ALL SELECT 'skewed', col_name, skew FROM ({sql_skew('dup_orders', DO_NUM)}) AS s WHERE skewed""")
def a24(spark, sf):
    return P.eda_findings(table(spark, sf, "dup_orders").drop("seq"))


@check("a5_load_validation", fixtures=["dirty_orders"], sql=f"""
SELECT 'empty' AS "check", CAST(NULL AS VARCHAR) AS col_name, CASE WHEN count(*) = 0 THEN 'true' ELSE 'false' END AS value
FROM dirty_orders
UNION ALL SELECT 'empty_rows', NULL, CAST(count(*) FILTER (WHERE {' AND '.join(f'{c} IS NULL' for c in DO_ALL)}) AS VARCHAR)
FROM dirty_orders
UNION ALL SELECT 'duplicates', NULL, CAST(coalesce(sum(c - 1), 0) AS VARCHAR)
FROM (SELECT count(*) AS c FROM dirty_orders GROUP BY {', '.join(DO_ALL)}) AS g
UNION ALL SELECT 'nulls', col_name, CAST(nulls AS VARCHAR) FROM ({sql_nulls_by_column('dirty_orders', DO_ALL)}) AS n
WHERE nulls > 0
UNION ALL SELECT 'dtype', c, t FROM (VALUES {', '.join(f"('{c}', '{DO_TYPES[c]}')" for c in DO_ALL)}) AS v(c, t)""")
def a5(spark, sf):
    return P.load_validation(table(spark, sf, "dirty_orders"))
