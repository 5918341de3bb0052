"""Duplicate detection, removal and merging (keep first / last / none, per-column merge).

Row order is explicit: every order-sensitive operator takes ``order_by`` columns (the
reference relies on an implicit row index).  Keep-first/last and keep-none are aggregates
of ``min/max(struct(order, row))`` per key, which Spark combines map-side, so a key that
holds a third of the table costs one small partial row per task instead of one huge sorted
window partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualab.functions.columns import qcol
from qualab.functions.hashing import group_sizes
from qualab.functions.ranks import exact_quantiles_from_counts, value_counts


# copies of one identical row expanded per array (bounds the memory of a hot group)
COPY_CHUNK = 100_000


def _subset(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    cols = [c for c in (columns or df.columns) if c in df.columns]
    return cols or list(df.columns)


def _others(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _row_struct(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> Column:
    """struct(order columns, then every non-key column) — the comparison order of a row."""
    rest = [c for c in _others(df, keys) if c not in order_by]
    fields = [qcol(c).alias(f"o{i}") for i, c in enumerate(order_by)] + \
             [qcol(c).alias(f"r{i}") for i, c in enumerate(rest)]
    return F.struct(*fields) if fields else F.struct(F.lit(1).alias("_one"))


def _unpack(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], packed: str) -> list[Column]:
    rest = [c for c in _others(df, keys) if c not in order_by]
    names = {c: f"{packed}.o{i}" for i, c in enumerate(order_by) if c not in keys}
    names.update({c: f"{packed}.r{i}" for i, c in enumerate(rest)})
    return [qcol(c) if c in keys else F.col(names[c]).alias(c) for c in df.columns]


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first",
                    order_by: Sequence[str] = ()) -> DataFrame:
    """Keep the first / last row of each group (by ``order_by``), or drop every member
    of a duplicated group (``keep='none'``).  NULL equals NULL in the key, as in pandas."""
    keys = _subset(df, columns)
    order_by = [c for c in order_by]
    if keep not in ("first", "last", "none"):
        raise ValueError("keep must be 'first', 'last' or 'none'")
    if set(keys) == set(df.columns):
        return df.dropDuplicates() if keep != "none" else \
            df.groupBy(*[qcol(c) for c in keys]).agg(F.count(F.lit(1)).alias("_n")) \
              .where(F.col("_n") == 1).drop("_n")
    if keep != "none" and not order_by:
        raise ValueError(f"keep={keep!r} needs order_by: a table has no first or last row of its own")
    row = _row_struct(df, keys, order_by)
    pick = F.max(row) if keep == "last" else F.min(row)
    g = df.groupBy(*[qcol(c) for c in keys]).agg(pick.alias("_row"), F.count(F.lit(1)).alias("_n"))
    if keep == "none":
        g = g.where(F.col("_n") == 1)
    return g.select(*_unpack(df, keys, order_by, "_row"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None,
                   order_by: Sequence[str] = ()) -> DataFrame:
    """Rows after the first of their group (``order_by`` decides which is first).

    The per-group first row is an aggregate; rows are matched back with a null-safe join on
    the key (AQE's skew-join split handles a hot key on the large side)."""
    keys = _subset(df, columns)
    if set(keys) == set(df.columns):
        # identical rows: every copy beyond the first is the same row, so the group's count is
        # expanded back into rows — in bounded chunks spread over tasks, never as one array
        g = df.groupBy(*[qcol(c) for c in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        extra = F.col("_n") - 1
        chunks = g.select("*", F.explode(F.sequence(F.lit(0), F.floor((extra - 1) / COPY_CHUNK).cast("bigint"))).alias("_c"))
        chunks = chunks.repartition(F.col("_c"), *[qcol(c) for c in keys])
        lo = F.col("_c") * COPY_CHUNK
        hi = F.least(lo + COPY_CHUNK, extra) - 1
        return chunks.select("*", F.explode(F.sequence(lo, hi)).alias("_copy")).select(*[qcol(c) for c in df.columns])
    row = _row_struct(df, keys, order_by)
    firsts = df.groupBy(*[qcol(c) for c in keys]).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n")) \
               .where(F.col("_n") > 1)
    firsts = firsts.select(*[qcol(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_first")
    cond = [df[c].eqNullSafe(firsts[f"_k{i}"]) for i, c in enumerate(keys)]
    joined = df.join(firsts, cond, "inner").where(row != F.col("_first"))
    return joined.select(*[df[c] for c in df.columns])


def duplicate_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D1 headline: duplicate count, % of rows, number of groups, largest group."""
    keys = _subset(df, columns)
    g = group_sizes(df, keys)
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"),
                 F.count_if(F.col("_n") > 1).cast("bigint").alias("n_groups"),
                 F.max(F.when(F.col("_n") > 1, F.col("_n"))).alias("largest_group")) \
            .select("duplicates", F.when(F.col("n_rows") > 0, F.col("duplicates") / F.col("n_rows") * 100.0)
                    .otherwise(F.lit(0.0)).alias("duplicate_pct"), "n_groups", "largest_group")


def reduction_stats(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """Rows before, after, removed and % removed for a drop_duplicates call (one aggregate)."""
    keys = _subset(df, columns)
    g = group_sizes(df, keys)
    after = F.count_if(F.col("_n") == 1) if keep == "none" else F.count(F.lit(1))
    s = g.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("before"), after.cast("bigint").alias("after"))
    return s.select("before", "after", (F.col("before") - F.col("after")).alias("removed"),
                    F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before") * 100.0)
                    .otherwise(F.lit(0.0)).alias("removed_pct"))


MERGE_FUNCS = ("first", "last", "sum", "mean", "min", "max", "count", "median", "std", "nunique", "mode")


def merge_duplicates(df: DataFrame, columns: Sequence[str], how: Mapping[str, str] | None = None,
                     order_by: Sequence[str] = (), drop_null_keys: bool = False) -> DataFrame:
    """One row per key; every other column aggregated by ``how[col]`` (default ``first``).

    ``first``/``last`` are the first/last *non-null* value in ``order_by`` order.  ``median``
    and ``mode`` run as separate distributed aggregations joined back on the key.
    """
    keys = _subset(df, columns)
    how = dict(how or {})
    src = df.dropna(subset=keys) if drop_null_keys else df
    order = [qcol(c) for c in order_by]
    simple: list[Column] = []
    medians, modes = [], []
    for c in _others(df, keys):
        fn = how.get(c, "first")
        v = qcol(c)
        if fn in ("first", "last"):
            if not order_by:
                raise ValueError(f"{fn!r} of {c} needs order_by: a table has no first or last row of its own")
            s = F.when(v.isNotNull(), F.struct(*order, v.alias("_v")))
            simple.append((F.min(s) if fn == "first" else F.max(s))["_v"].alias(c))
        elif fn == "sum":
            simple.append(F.sum(v).alias(c))
        elif fn == "mean":
            simple.append(F.avg(v).alias(c))
        elif fn == "min":
            simple.append(F.min(v).alias(c))
        elif fn == "max":
            simple.append(F.max(v).alias(c))
        elif fn == "count":
            simple.append(F.count(v).alias(c))
        elif fn == "std":
            simple.append(F.stddev_samp(v).alias(c))
        elif fn == "nunique":
            simple.append(F.count_distinct(v).alias(c))
        elif fn == "median":
            medians.append(c)
        elif fn == "mode":
            modes.append(c)
        else:
            raise ValueError(f"unknown merge function {fn!r}; use one of {MERGE_FUNCS}")
    kcols = [qcol(k) for k in keys]
    out = src.groupBy(*kcols).agg(F.count(F.lit(1)).alias("_n"), *simple).drop("_n")
    for c in medians:
        q = exact_quantiles_from_counts(value_counts(src.select(*kcols, qcol(c).cast("double").alias("_v")),
                                                     keys, "_v"), keys, "_v", [0.5])
        q = q.select(*[qcol(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col("q").alias(c))
        out = out.join(q, [out[k].eqNullSafe(q[f"_m{i}"]) for i, k in enumerate(keys)], "left") \
                 .drop(*[f"_m{i}" for i in range(len(keys))])
    for c in modes:
        vc = src.where(qcol(c).isNotNull()).groupBy(*kcols, qcol(c).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
        m = vc.groupBy(*kcols).agg(F.min(F.struct((-F.col("_w")).alias("nw"), F.col("_v").alias("v"))).alias("_b"))
        m = m.select(*[qcol(k).alias(f"_m{i}") for i, k in enumerate(keys)], F.col("_b.v").alias(c))
        out = out.join(m, [out[k].eqNullSafe(m[f"_m{i}"]) for i, k in enumerate(keys)], "left") \
                 .drop(*[f"_m{i}" for i in range(len(keys))])
    return out.select(*[qcol(c) for c in df.columns])


def duplicate_preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` surplus copies of fully identical rows (a preview: the limit is the feature)."""
    dups = duplicate_rows(df)
    cols = list(order_by) or df.columns
    return dups.orderBy(*[qcol(c) for c in cols]).limit(n)
