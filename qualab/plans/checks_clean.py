"""Checked queries for duplicate handling."""

from __future__ import annotations

from qualab.operators import dedup as D
from qualab.plans.fixtures import table
from qualab.plans.registry import check

ORD = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@check("d1_duplicate_rows_full", fixtures=["dup_orders"], round_cols=["o_totalprice"], sql=f"""
SELECT {ORD} FROM (SELECT *, row_number() OVER (PARTITION BY {ORD} ORDER BY seq) AS rn FROM dup_orders) AS t
WHERE rn > 1""")
def d1_full(spark, sf):
    return D.duplicate_rows(table(spark, sf, "dup_orders").drop("seq"))


@check("d1_duplicate_rows_subset", fixtures=["dup_orders"], round_cols=["o_totalprice"], sql=f"""
SELECT {ORD}, seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus
                                                  ORDER BY o_orderkey, seq) AS rn FROM dup_orders) AS t
WHERE rn > 1""")
def d1_subset(spark, sf):
    return D.duplicate_rows(table(spark, sf, "dup_orders"), ["o_custkey", "o_orderstatus"],
                            order_by=["o_orderkey", "seq"])


@check("d1_duplicate_report", fixtures=["dup_null_keys"], round_cols=["duplicate_pct"], sql="""
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicates,
       CAST(sum(c - 1) AS DOUBLE) / CAST(sum(c) AS DOUBLE) * 100.0 AS duplicate_pct,
       count(*) FILTER (WHERE c > 1) AS n_groups, max(c) FILTER (WHERE c > 1) AS largest_group
FROM (SELECT count(*) AS c FROM dup_null_keys GROUP BY grp, prio) AS g""")
def d1_report(spark, sf):
    return D.duplicate_report(table(spark, sf, "dup_null_keys"), ["grp", "prio"])


def _keep_sql(direction: str) -> str:
    return f"""
SELECT {ORD}, seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
                        ORDER BY o_orderdate {direction}, o_orderkey {direction}, seq {direction}) AS rn
                        FROM dup_orders) AS t WHERE rn = 1"""


@check("d2_keep_first", fixtures=["dup_orders"], round_cols=["o_totalprice"], sql=_keep_sql("ASC"))
def d2(spark, sf):
    return D.drop_duplicates(table(spark, sf, "dup_orders"), ["o_custkey"], "first",
                             order_by=["o_orderdate", "o_orderkey", "seq"])


@check("d3_keep_last", fixtures=["dup_orders"], round_cols=["o_totalprice"], sql=_keep_sql("DESC"))
def d3(spark, sf):
    return D.drop_duplicates(table(spark, sf, "dup_orders"), ["o_custkey"], "last",
                             order_by=["o_orderdate", "o_orderkey", "seq"])


@check("d4_keep_none", fixtures=["dup_orders"], round_cols=["o_totalprice"], sql=f"""
SELECT {ORD}, seq FROM (SELECT *, count(*) OVER (PARTITION BY o_orderkey, o_orderstatus) AS c FROM dup_orders) AS t
WHERE c = 1""")
def d4(spark, sf):
    return D.drop_duplicates(table(spark, sf, "dup_orders"), ["o_orderkey", "o_orderstatus"], "none")


@check("d2_keep_first_full_row", fixtures=["dup_orders"], round_cols=["o_totalprice"],
       sql=f"SELECT DISTINCT {ORD} FROM dup_orders")
def d2_full(spark, sf):
    return D.drop_duplicates(table(spark, sf, "dup_orders").drop("seq"))


@check("d5_reduction_stats", fixtures=["dup_null_keys"], round_cols=["removed_pct"], sql="""
SELECT CAST(sum(c) AS BIGINT) AS before, count(*) AS after, CAST(sum(c) AS BIGINT) - count(*) AS removed,
       CAST(CAST(sum(c) AS BIGINT) - count(*) AS DOUBLE) / CAST(sum(c) AS DOUBLE) * 100.0 AS removed_pct
FROM (SELECT count(*) AS c FROM dup_null_keys GROUP BY grp, prio, o_orderstatus) AS g""")
def d5(spark, sf):
    return D.reduction_stats(table(spark, sf, "dup_null_keys"), ["grp", "prio", "o_orderstatus"], "first")


@check("d5_reduction_stats_none", fixtures=["dup_orders"], round_cols=["removed_pct"], sql="""
SELECT CAST(sum(c) AS BIGINT) AS before, count(*) FILTER (WHERE c = 1) AS after,
       CAST(sum(c) AS BIGINT) - count(*) FILTER (WHERE c = 1) AS removed,
       CAST(CAST(sum(c) AS BIGINT) - count(*) FILTER (WHERE c = 1) AS DOUBLE) / CAST(sum(c) AS DOUBLE) * 100.0 AS removed_pct
FROM (SELECT count(*) AS c FROM dup_orders GROUP BY o_orderkey) AS g""")
def d5_none(spark, sf):
    return D.reduction_stats(table(spark, sf, "dup_orders"), ["o_orderkey"], "none")


@check("d6_merge_duplicates", fixtures=["dup_null_keys"], round_cols=["o_totalprice"], sql="""
WITH m AS (SELECT grp, prio, count(*) AS c, median(o_totalprice) AS o_totalprice FROM dup_null_keys GROUP BY grp, prio),
     f AS (SELECT grp, prio, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM dup_null_keys GROUP BY grp, prio),
     mo AS (SELECT grp, prio, o_orderstatus FROM (
              SELECT grp, prio, o_orderstatus, row_number() OVER (PARTITION BY grp, prio ORDER BY count(*) DESC, o_orderstatus) AS rn
              FROM dup_null_keys WHERE o_orderstatus IS NOT NULL GROUP BY grp, prio, o_orderstatus) AS x WHERE rn = 1)
SELECT f.o_orderkey, m.grp, m.prio, m.o_totalprice, mo.o_orderstatus
FROM m JOIN f ON m.grp IS NOT DISTINCT FROM f.grp AND m.prio IS NOT DISTINCT FROM f.prio
LEFT JOIN mo ON m.grp IS NOT DISTINCT FROM mo.grp AND m.prio IS NOT DISTINCT FROM mo.prio""")
def d6(spark, sf):
    return D.merge_duplicates(table(spark, sf, "dup_null_keys"), ["grp", "prio"],
                              {"o_totalprice": "median", "o_orderstatus": "mode", "o_orderkey": "first"},
                              order_by=["o_orderkey"])


@check("d6_merge_duplicates_aggs", fixtures=["dup_orders"], round_cols=["o_totalprice", "seq"], sql="""
SELECT o_orderkey, arg_max(o_custkey, seq) AS o_custkey, count(o_orderstatus) AS o_orderstatus,
       sum(o_totalprice) AS o_totalprice, max(o_orderdate) AS o_orderdate,
       count(DISTINCT o_orderpriority) AS o_orderpriority, avg(seq) AS seq
FROM dup_orders GROUP BY o_orderkey""")
def d6_aggs(spark, sf):
    return D.merge_duplicates(table(spark, sf, "dup_orders"), ["o_orderkey"],
                              {"o_custkey": "last", "o_orderstatus": "count", "o_totalprice": "sum",
                               "o_orderdate": "max", "o_orderpriority": "nunique", "seq": "mean"},
                              order_by=["seq"])


@check("d7_duplicate_preview", fixtures=["dup_orders"], round_cols=["o_totalprice"], sql=f"""
SELECT {ORD} FROM (SELECT *, row_number() OVER (PARTITION BY {ORD} ORDER BY seq) AS rn FROM dup_orders) AS t
WHERE rn > 1 ORDER BY o_orderkey LIMIT 5""")
def d7(spark, sf):
    return D.duplicate_preview(table(spark, sf, "dup_orders").drop("seq"), 5, order_by=["o_orderkey"])
