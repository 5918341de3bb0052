"""Input tables and derived fixture views.

The derived "dirty" views are written once as SQL text that both Spark SQL and DuckDB
accept, so the Spark query and its SQL oracle read exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_QTY = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"

FIXTURE_SQL: dict[str, str] = {
    # nulls in two columns, a fully-null slice and ×100 outliers
    "dirty_orders": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 997 = 0 OR o_orderkey % 7 = 0 THEN NULL
            WHEN o_orderkey % 501 = 0 THEN o_totalprice * CAST(100 AS DOUBLE)
            ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
       CASE WHEN o_orderkey % 997 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""",
    # every 13th order twice; seq breaks the tie between the copies
    "dup_orders": """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 0 AS seq FROM orders
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 1 AS seq FROM orders
WHERE o_orderkey % 13 = 0""",
    # grouping keys with NULLs
    "dup_null_keys": """
SELECT o_orderkey, o_custkey % 20 AS grp,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS prio,
       o_totalprice, o_orderstatus
FROM orders""",
    "text_numbers": f"""
SELECT l_orderkey, l_linenumber, l_quantity,
       CASE l_orderkey % 5
            WHEN 0 THEN {_QTY}
            WHEN 1 THEN {_QTY} || ' kg'
            WHEN 2 THEN '-' || {_QTY} || '.5'
            WHEN 3 THEN {_QTY} || 'd'
            ELSE 'abc' END AS qty_text,
       {_QTY} AS qty_plain,
       CAST(l_extendedprice AS STRING) AS price_text
FROM lineitem""",
    "text_dates": """
SELECT o_orderkey, d_iso,
       substr(d_iso, 9, 2) || '/' || substr(d_iso, 6, 2) || '/' || substr(d_iso, 1, 4) AS d_dmy,
       replace(d_iso, '-', '/') AS d_ymd,
       CASE o_orderkey % 4
            WHEN 0 THEN d_iso
            WHEN 1 THEN substr(d_iso, 9, 2) || '/' || substr(d_iso, 6, 2) || '/' || substr(d_iso, 1, 4)
            WHEN 2 THEN replace(d_iso, '-', '/')
            ELSE 'bad' END AS d_mixed,
       CASE WHEN o_orderkey % 10 = 0 THEN 'bad' ELSE d_iso END AS d_mostly_iso
FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d_iso FROM orders) AS t""",
    "units": """
SELECT l_orderkey, l_linenumber, l_quantity,
       CAST(l_quantity AS STRING) || CASE WHEN l_orderkey % 10 = 0 THEN ' kg' ELSE ' g' END AS weight_text,
       CAST(20 AS DOUBLE) + l_quantity % CAST(25 AS DOUBLE) AS temp_c
FROM lineitem""",
    "bool_text": """
SELECT o_orderkey,
       CASE o_orderkey % 8 WHEN 0 THEN 'si' WHEN 1 THEN 'no' WHEN 2 THEN 'true' WHEN 3 THEN 'false'
            WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'y' ELSE 'other' END AS flag_text,
       o_totalprice
FROM orders""",
}

# Synthetic model outputs (no model needed): weights per model name.
BINARY_MODELS = {"m_quantity": (20, 1000, 500), "m_discount": (10, 2000, 400), "m_mixed": (30, 500, 300)}


def _binary_sql() -> str:
    parts = []
    for name, (a, b, c) in BINARY_MODELS.items():
        prob = (f"LEAST(GREATEST((l_quantity * {a} + l_discount * {b} + {c} * "
                f"CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE)) / CAST(2000 AS DOUBLE), "
                f"CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))")
        parts.append(f"""
SELECT 'run_bin' AS run_id, '{name}' AS model,
       CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS row_key,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS label,
       CAST(CASE WHEN {prob} >= 0.5 THEN 1 ELSE 0 END AS DOUBLE) AS prediction,
       {prob} AS probability
FROM lineitem""")
    return "\nUNION ALL".join(parts)


_EVENT_LABEL = ("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 "
                "WHEN 'signup' THEN 3 ELSE 4 END")


def _multi_scores_sql() -> str:
    parts = []
    for k in range(5):
        parts.append(f"""
SELECT 'run_multi' AS run_id, 'm_events' AS model, CAST(event_id AS STRING) AS row_key,
       CAST({_EVENT_LABEL} AS DOUBLE) AS label, CAST({k} AS DOUBLE) AS class,
       CAST(CASE WHEN {_EVENT_LABEL} = {k} THEN 35 ELSE 0 END AS DOUBLE) / CAST(100 AS DOUBLE)
         + CAST((event_id * {k + 7}) % 101 AS DOUBLE) / CAST(202 AS DOUBLE) AS score
FROM events""")
    return "\nUNION ALL".join(parts)


FIXTURE_SQL["pred_binary"] = _binary_sql()
FIXTURE_SQL["pred_multi"] = f"""
SELECT 'run_multi' AS run_id, 'm_events' AS model, CAST(event_id AS STRING) AS row_key,
       CAST({_EVENT_LABEL} AS DOUBLE) AS label,
       CAST(({_EVENT_LABEL} + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 5 AS DOUBLE) AS prediction,
       CAST(NULL AS DOUBLE) AS probability
FROM events"""
FIXTURE_SQL["multi_scores"] = _multi_scores_sql()
FIXTURE_SQL["pred_reg"] = """
SELECT 'run_reg' AS run_id, 'r_shift' AS model, CAST(o_orderkey AS STRING) AS row_key,
       o_totalprice AS label, o_totalprice * CAST(0.9 AS DOUBLE) + CAST((o_orderkey % 100) * 10 AS DOUBLE) AS prediction,
       CAST(NULL AS DOUBLE) AS probability
FROM orders
UNION ALL
SELECT 'run_reg' AS run_id, 'r_noise' AS model, CAST(o_orderkey AS STRING) AS row_key,
       o_totalprice AS label, o_totalprice * CAST(1.05 AS DOUBLE) - CAST((o_orderkey % 37) * 20 AS DOUBLE) AS prediction,
       CAST(NULL AS DOUBLE) AS probability
FROM orders"""

# fixture → fixtures it reads (base tables are always available)
_DEPENDS: dict[str, list[str]] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import os
    from qualab.sources.files import balanced
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balanced(df) if os.environ.get("QUALAB_BALANCE", "0") == "1" else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived fixture view as a lazy DataFrame."""
    if name in BASE_TABLES:
        return _read(spark, sf_dir, name)
    if name not in FIXTURE_SQL:
        raise KeyError(name)
    register_base(spark, sf_dir)
    return spark.sql(FIXTURE_SQL[name])


def register_base(spark: SparkSession, sf_dir: str) -> None:
    """Expose the base tables as temporary views (lazy; nothing is read here)."""
    for t in BASE_TABLES:
        _read(spark, sf_dir, t).createOrReplaceTempView(t)


def with_fixtures(sql: str, names: list[str]) -> str:
    """Prefix oracle SQL with the fixture views it reads, as CTEs."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]}\n)" for n in names)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
