"""Data-quality profiling (basic metrics, nulls, outliers, duplicates, column statistics,
global score, findings) and the exploratory aggregates behind every chart.

All operators are lazy.  Per-column work is done in *one* pass over a long (column, value)
form instead of one job per column; exact quantiles use the distributed rank scheme of
:mod:`qualab.functions.ranks`, so no column is ever gathered into a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualab.functions.columns import (as_double, as_text, clean_value, datetime_columns, epoch_seconds, is_datetime,
                                      is_numeric, is_text, kind_of, missing, numeric_columns,
                                      qcol, text_columns)
from qualab.functions.hashing import group_sizes
from qualab.functions.ranks import exact_quantiles_from_counts, value_counts
from qualab.functions.shape import long_form, merge_single_rows

# Class labels and cut points that must equal the reference's output.
NULL_CLASSES = [(5.0, "Excelente"), (20.0, "Buena"), (50.0, "Regular"), (100.0, "Crítica")]
GRADES = [(90.0, "Excelente"), (75.0, "Buena"), (50.0, "Regular")]
GRADE_FALLBACK = "Deficiente"


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


# --------------------------------------------------------------------------- A1, A2, A4
def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """(col_name, n_distinct): non-null distinct values per column.

    Exact mode unpivots the columns *per data type* (values keep their native type, no text
    formatting) and counts (column, value) groups with map-side combining; ``approx=True``
    uses HyperLogLog in a single aggregate with no shuffle of values.
    """
    cols = list(columns or df.columns)
    if approx:
        wide = df.agg(*[F.approx_count_distinct(clean_value(c, df.schema[c].dataType)).alias(f"_d{i}")
                        for i, c in enumerate(cols)])
        return long_form(wide, [], {c: F.col(f"_d{i}") for i, c in enumerate(cols)}, value_col="n_distinct")
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out = None
    for _, members in sorted(groups.items()):
        long = long_form(df, [], {c: clean_value(c, df.schema[c].dataType) for c in members})
        per_value = long.where(F.col("value").isNotNull()).groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("w"))
        part = per_value.groupBy("col_name").agg(F.count(F.lit(1)).alias("n_distinct"))
        out = part if out is None else out.unionByName(part)
    return out


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``duplicate_rows``: rows beyond the first of each identical group (NULL = NULL)."""
    cols = list(columns or df.columns)
    groups = group_sizes(df, cols)
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def basic_metrics(df: DataFrame, approx_distinct: bool = False, vp: DataFrame | None = None) -> DataFrame:
    """A1: rows, columns, null cells, % null, duplicate rows, % duplicates, mean distinct, completeness.

    Two reads of the table: the value profile (nulls, distinct) and the full-row group-by
    (duplicates); ``approx_distinct`` replaces the profile by one HyperLogLog aggregate."""
    cols = df.columns
    ncols = len(cols)
    if approx_distinct or not cols:
        null_cells = reduce(add, [F.count_if(missing(qcol(c), df.schema[c].dataType)) for c in cols]) \
            if cols else F.lit(0)
        base = df.agg(F.count(F.lit(1)).alias("n_rows"), null_cells.cast("bigint").alias("null_cells"))
        dist = distinct_counts(df, cols, approx_distinct).agg(
            (F.coalesce(F.sum("n_distinct"), F.lit(0)) / F.lit(float(max(ncols, 1)))).alias("mean_distinct"))
        one = merge_single_rows(base, duplicate_count(df), dist)
    else:
        pc = profile_counts(vp if vp is not None else value_profile(df))
        prof = pc.agg(F.max("n_rows").alias("n_rows"), F.sum("nulls").cast("bigint").alias("null_cells"),
                      (F.sum("n_distinct") / F.lit(float(ncols))).alias("mean_distinct"))
        # an empty table has no profile rows: fall back to zeros
        prof = prof.select(F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
                           F.coalesce("null_cells", F.lit(0)).cast("bigint").alias("null_cells"),
                           F.coalesce("mean_distinct", F.lit(0.0)).alias("mean_distinct"))
        one = merge_single_rows(prof, duplicate_count(df))
    null_pct = F.try_divide(F.col("null_cells").cast("double"),
                            (F.col("n_rows") * F.lit(ncols)).cast("double")) * 100.0
    dup_pct = F.when(F.col("n_rows") > 0, F.col("duplicate_rows") / F.col("n_rows") * 100.0).otherwise(F.lit(0.0))
    return one.select(
        F.col("n_rows"), F.lit(ncols).cast("bigint").alias("n_columns"), F.col("null_cells"),
        null_pct.alias("null_pct"), F.col("duplicate_rows"), dup_pct.alias("duplicate_pct"),
        F.col("mean_distinct"), (F.lit(100.0) - null_pct).alias("completeness"))


def null_class(pct: Column) -> Column:
    """Right-closed bins (0,5] (5,20] (20,50] (50,100]; 0 % falls outside every bin → NULL."""
    expr = None
    lower = 0.0
    for upper, label in NULL_CLASSES:
        cond = (pct > F.lit(lower)) & (pct <= F.lit(upper))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        lower = upper
    return expr


def nulls_by_column(df: DataFrame) -> DataFrame:
    """A2: column, nulls, pct, completeness, class — sorted by pct desc."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(missing(qcol(c), df.schema[c].dataType)).alias(f"_n{i}")
                    for i, c in enumerate(cols)])
    long = long_form(wide, ["_rows"], {c: F.col(f"_n{i}") for i, c in enumerate(cols)}, value_col="nulls")
    pct = F.try_divide(F.col("nulls").cast("double"), F.col("_rows").cast("double")) * 100.0
    return (long.select("col_name", "nulls", pct.alias("pct"))
            .select("col_name", "nulls", "pct", (F.lit(100.0) - F.col("pct")).alias("completeness"),
                    null_class(F.col("pct")).alias("null_class"))
            .orderBy(F.col("pct").desc(), F.col("col_name")))


def null_table(df: DataFrame, decimals: int = 2) -> DataFrame:
    """A3: rounded null table restricted to columns that have nulls."""
    return (nulls_by_column(df).where(F.col("nulls") > 0)
            .select("col_name", "nulls", F.round("pct", decimals).alias("pct"),
                    F.round("completeness", decimals).alias("completeness"), "null_class"))


def empty_rows(df: DataFrame) -> DataFrame:
    """A4: number of rows whose every column is missing."""
    cond = reduce(lambda a, b: a & b, [missing(qcol(c), df.schema[c].dataType) for c in df.columns])
    return df.agg(F.count_if(cond).cast("bigint").alias("empty_rows"))


# --------------------------------------------------------------------------- A6-A9
def numeric_long(df: DataFrame, columns: Sequence[str] | None = None,
                 ids: Sequence[str] = ()) -> DataFrame:
    """(ids..., column, value double) over the numeric (non-boolean) columns; NaN → NULL."""
    cols = [c for c in (columns or numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
    return long_form(df, [qcol(i) for i in ids], {c: as_double(c, df.schema[c].dataType) for c in cols})


def _numeric_counts(df: DataFrame, columns: Sequence[str] | None, vp: DataFrame | None) -> DataFrame:
    if vp is not None:
        cols = [c for c in (columns or numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
        return profile_numeric(vp, cols)
    return value_counts(numeric_long(df, columns), ["col_name"], "value")


def outlier_bounds(df: DataFrame, method: str = "iqr", threshold: float = 1.5,
                   columns: Sequence[str] | None = None, vp: DataFrame | None = None) -> DataFrame:
    """Per numeric column with more than one non-null value: n, q1, q3, iqr, mean, std, lower, upper."""
    counts = _numeric_counts(df, columns, vp)
    k = F.lit(float(threshold))
    if method == "iqr":
        q = exact_quantiles_from_counts(counts, ["col_name"], "value", [0.25, 0.75])
        stats = q.groupBy("col_name").agg(
            F.first("n").alias("n"),
            F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
            F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
        stats = stats.select("col_name", "n", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
                             F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"))
        lower = F.col("q1") - k * F.col("iqr")
        upper = F.col("q3") + k * F.col("iqr")
    elif method in ("zscore", "deviation"):
        stats = _moments(counts).select("col_name", "n", "mean", "std") if vp is not None else \
            numeric_long(df, columns).groupBy("col_name").agg(
                F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
        stats = stats.select("col_name", "n", F.lit(None).cast("double").alias("q1"),
                             F.lit(None).cast("double").alias("q3"), F.lit(None).cast("double").alias("iqr"),
                             "mean", "std")
        lower = F.col("mean") - k * F.col("std")
        upper = F.col("mean") + k * F.col("std")
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return stats.where(F.col("n") > 1).select("*", lower.alias("lower"), upper.alias("upper"))


def _is_outlier(method: str, threshold: float) -> Column:
    v = F.col("value")
    if method == "zscore":
        z = F.abs(F.try_divide(v - F.col("mean"), F.col("std")))
        return F.coalesce(z > F.lit(float(threshold)), F.lit(False))
    return (v < F.col("lower")) | (v > F.col("upper"))


def outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5,
             columns: Sequence[str] | None = None, vp: DataFrame | None = None) -> DataFrame:
    """Per column n, outlier count and % of non-null values plus the method's bounds.
    With a value profile ``vp`` nothing re-reads the table."""
    bounds = outlier_bounds(df, method, threshold, columns, vp)
    counts = _numeric_counts(df, columns, vp)
    # bounds has one row per numeric column: its size is bounded by the schema width
    flagged = (counts.join(F.broadcast(bounds.select("col_name", "lower", "upper", "mean", "std")), "col_name")
               .groupBy("col_name")
               .agg(F.sum(F.when(_is_outlier(method, threshold), F.col("w")).otherwise(F.lit(0))).alias("outliers")))
    return (bounds.join(flagged, "col_name")
            .select("col_name", F.lit(method).alias("method"), F.lit(float(threshold)).alias("threshold"),
                    "n", "outliers", (F.col("outliers") / F.col("n") * 100.0).alias("outlier_pct"),
                    "q1", "q3", "iqr", "mean", "std", "lower", "upper"))


def outlier_rows(df: DataFrame, keys: Sequence[str], method: str = "iqr", threshold: float = 1.5,
                 columns: Sequence[str] | None = None) -> DataFrame:
    """The offending rows as (keys..., column, value)."""
    bounds = outlier_bounds(df, method, threshold, columns)
    long = numeric_long(df, columns, ids=keys).where(F.col("value").isNotNull())
    return (long.join(F.broadcast(bounds.select("col_name", "lower", "upper", "mean", "std")), "col_name")
            .where(_is_outlier(method, threshold))
            .select(*keys, "col_name", "value"))


# --------------------------------------------------------------------------- A10
def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None,
                     drop_null_keys: bool = False) -> DataFrame:
    """A10 groups: every combination of the (existing) subset columns seen more than once."""
    cols = [c for c in (columns or df.columns) if c in df.columns]
    src = df.dropna(subset=cols) if drop_null_keys else df
    return (src.groupBy(*[qcol(c) for c in cols]).agg(F.count(F.lit(1)).alias("size"))
            .where(F.col("size") > 1).orderBy(F.col("size").desc()))


def duplicate_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A10 headline: duplicate count, %, and number of duplicate groups."""
    cols = [c for c in (columns or df.columns) if c in df.columns]
    groups = group_sizes(df, cols)
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count_if(F.col("_n") > 1).cast("bigint").alias("n_groups"),
    ).select("duplicates", F.when(F.col("n_rows") > 0, F.col("duplicates") / F.col("n_rows") * 100.0)
             .otherwise(F.lit(0.0)).alias("duplicate_pct"), "n_groups")


# --------------------------------------------------------------------------- A11
def top_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct, top, top_freq): most frequent non-null value (ties: smallest value)."""
    long = long_form(df, [], {c: as_text(c, df.schema[c].dataType) for c in columns})
    per_value = long.where(F.col("value").isNotNull()).groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("w"))
    # min over (-count, value) is the most frequent value, ties broken by value ascending;
    # an aggregate (not a window) so a high-cardinality column is never sent to one task
    best = F.min(F.struct((-F.col("w")).alias("nw"), F.col("value").alias("v")))
    return per_value.groupBy("col_name").agg(F.count(F.lit(1)).alias("n_distinct"), best.alias("_b")) \
        .select("col_name", "n_distinct", F.col("_b.v").alias("top"), (-F.col("_b.nw")).alias("top_freq"))


def column_stats(df: DataFrame, vp: DataFrame | None = None) -> DataFrame:
    """One row per column with common, numeric, text and datetime statistics.

    Everything derives from one value profile (one scan, one shuffle): nulls and distinct
    counts per column, numeric moments and the exact median from the numeric value counts,
    the top text value and mean length, and the datetime range."""
    schema = df.schema
    cols = df.columns
    num = [c for c in cols if is_numeric(schema[c].dataType)]
    txt = [c for c in cols if is_text(schema[c].dataType)]
    dts = [c for c in cols if is_datetime(schema[c].dataType)]
    vp = vp if vp is not None else value_profile(df)
    pc = profile_counts(vp).select("col_name", "nulls", "n_distinct",
                                   (F.col("nulls") / F.col("n_rows") * 100.0).alias("null_pct"))
    kinds = df.sparkSession.createDataFrame(
        [(c, schema[c].dataType.simpleString(), kind_of(schema[c].dataType)) for c in cols],
        "col_name string, type string, kind string")
    out = kinds.join(pc, "col_name", "left")
    if num:
        counts = profile_numeric(vp, num)
        med = exact_quantiles_from_counts(counts, ["col_name"], "value", [0.5]).select("col_name", F.col("q").alias("median"))
        out = out.join(_moments(counts).drop("n"), "col_name", "left").join(med, "col_name", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(n) for n in ("min", "max", "mean", "std", "median")])
    if txt:
        tv = vp.where(F.col("col_name").isin(txt) & F.col("value").isNotNull()).select("col_name", F.col("value.s").alias("s"), "w")
        best = F.min(F.struct((-F.col("w")).alias("nw"), F.col("s").alias("v")))
        tstats = tv.groupBy("col_name").agg(best.alias("_b"),
                                            (F.sum(F.col("w") * F.length("s")) / F.sum("w")).alias("mean_length"))
        out = out.join(tstats.select("col_name", F.col("_b.v").alias("top"), (-F.col("_b.nw")).alias("top_freq"),
                                     "mean_length"), "col_name", "left")
    else:
        out = out.select("*", F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("top_freq"),
                         F.lit(None).cast("double").alias("mean_length"))
    if dts:
        rng = vp.where(F.col("col_name").isin(dts) & F.col("value").isNotNull()).groupBy("col_name").agg(
            F.min("value.t").alias("date_min"), F.max("value.t").alias("date_max"))
        days = F.floor((epoch_seconds(F.col("date_max")) - epoch_seconds(F.col("date_min"))) / F.lit(86400))
        out = out.join(rng.select("*", days.cast("bigint").alias("range_days")), "col_name", "left")
    else:
        out = out.select("*", F.lit(None).cast("timestamp_ntz").alias("date_min"),
                         F.lit(None).cast("timestamp_ntz").alias("date_max"),
                         F.lit(None).cast("bigint").alias("range_days"))
    return out.select(
        "col_name", "type", "kind", "nulls", "null_pct", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "min", "max", "mean", "median", "std", "top", "top_freq", "mean_length", "date_min", "date_max", "range_days")


# --------------------------------------------------------------------------- A12, A13
def quality_score(df: DataFrame, approx_distinct: bool = False, vp: DataFrame | None = None) -> DataFrame:
    """0-100 score = completeness (40) + duplicates (30) + outliers (30) and its grade."""
    if approx_distinct:
        vp = None
    elif vp is None:
        vp = value_profile(df)
    m = basic_metrics(df, approx_distinct, vp)
    o = outliers(df, "iqr", 1.5, vp=vp).agg(F.avg("outlier_pct").alias("mean_outlier_pct"))
    one = merge_single_rows(m, o)
    s_comp = F.least(F.lit(40.0), F.col("completeness") * 0.4)
    s_dup = F.least(F.lit(30.0), F.lit(30.0) * (F.lit(1.0) - F.col("duplicate_pct") / 100.0))
    s_out = F.least(F.lit(30.0), F.lit(30.0) * (F.lit(1.0) - F.coalesce("mean_outlier_pct", F.lit(0.0)) / 100.0))
    scored = one.select("*", s_comp.alias("score_completeness"), s_dup.alias("score_duplicates"),
                        s_out.alias("score_outliers"))
    total = F.col("score_completeness") + F.col("score_duplicates") + F.col("score_outliers")
    scored = scored.withColumn("score", total)
    grade = None
    for cut, label in GRADES:
        cond = F.col("score") >= F.lit(cut)
        grade = F.when(cond, F.lit(label)) if grade is None else grade.when(cond, F.lit(label))
    return scored.select(
        "score", grade.otherwise(F.lit(GRADE_FALLBACK)).alias("grade"), "score_completeness",
        "score_duplicates", "score_outliers", "n_rows", "n_columns", "null_cells", "null_pct",
        "duplicate_rows", "duplicate_pct", "mean_distinct", "completeness",
        F.coalesce("mean_outlier_pct", F.lit(0.0)).alias("mean_outlier_pct"))


def quality_findings(df: DataFrame) -> DataFrame:
    """Rule table (severity, rule, value); 'no_issues' when at most one finding fired."""
    vp = value_profile(df)       # one profile: outliers and score reuse its exchange
    nulls = nulls_by_column(df).agg(
        F.count_if(F.col("pct") > 50).alias("n_over_50"),
        F.count_if((F.col("pct") > 20) & (F.col("pct") <= 50)).alias("n_20_50"))
    outl = outliers(df, "iqr", 1.5, vp=vp).agg(F.count_if(F.col("outlier_pct") > 5).alias("n_outlier_cols"))
    score = quality_score(df, vp=vp).select("grade", "duplicate_pct")
    one = merge_single_rows(nulls, outl, score)
    sev = (F.when(F.col("grade") == "Deficiente", "error").when(F.col("grade") == "Regular", "warning")
           .when(F.col("grade") == "Buena", "info").otherwise("success"))
    def rule(severity: Column, name: Column, value: Column) -> Column:
        return F.struct(severity.alias("severity"), name.alias("rule"), value.cast("double").alias("value"))

    rules = F.array(
        F.when(F.col("n_over_50") > 0, rule(F.lit("warning"), F.lit("nulls_over_50"), F.col("n_over_50"))),
        F.when(F.col("n_20_50") > 0, rule(F.lit("warning"), F.lit("nulls_20_50"), F.col("n_20_50"))),
        F.when(F.col("duplicate_pct") > 5, rule(F.lit("warning"), F.lit("duplicates_over_5"), F.col("duplicate_pct"))),
        F.when(F.col("n_outlier_cols") > 0, rule(F.lit("info"), F.lit("outliers_over_5"), F.col("n_outlier_cols"))),
        rule(sev, F.concat(F.lit("grade_"), F.col("grade")), F.lit(None)),
    )
    fired = F.filter(rules, lambda r: r.isNotNull())
    with_ok = F.when(F.size(fired) <= 1, F.concat(fired, F.array(
        rule(F.lit("success"), F.lit("no_issues"), F.lit(None))))).otherwise(fired)
    return one.select(F.inline(with_ok))


# --------------------------------------------------------------------------- A14-A25 (EDA)
def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, 25 %, 50 %, 75 %, max per numeric column (exact quantiles).
    Moments are one shuffle-free aggregate over the raw values (plain summation, the standard
    numerics); quantiles come from the map-side-combined value counts."""
    nl = numeric_long(df, columns)
    moments = nl.groupBy("col_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles_from_counts(value_counts(nl, ["col_name"], "value"), ["col_name"], "value",
                                    [0.25, 0.5, 0.75])
    qw = q.groupBy("col_name").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                     for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])
    return moments.join(qw, "col_name", "left").select(
        "col_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def categorical_describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count (non-null), unique, top, freq per text column."""
    cols = list(columns or text_columns(df))
    counts = long_form(df, [], {c: qcol(c).cast("string") for c in cols}).groupBy("col_name") \
        .agg(F.count("value").alias("count"))
    return counts.join(top_values(df, cols), "col_name", "left").select(
        "col_name", "count", F.coalesce("n_distinct", F.lit(0)).alias("unique"),
        F.col("top"), F.col("top_freq").alias("freq"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Value, count, pct of the non-null rows; most frequent first."""
    counts = df.where(qcol(column).isNotNull()).groupBy(qcol(column).alias("value")) \
        .agg(F.count(F.lit(1)).alias("count"))
    # the total is a scalar subquery: no window over all rows, no join
    total = df.where(qcol(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return counts.select("value", "count", (F.col("count") / total * 100.0).alias("pct")) \
        .orderBy(F.col("count").desc(), F.col("value"))


def _range_bounds(df: DataFrame, column: str) -> tuple[Column, Column]:
    v = as_double(column, df.schema[column].dataType)
    lo = df.agg(F.min(v)).scalar()
    hi = df.agg(F.max(v)).scalar()
    return lo, hi


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] with the maximum in the last bin (numpy rule);
    all ``bins`` rows are returned, empty ones with count 0."""
    v = as_double(column, df.schema[column].dataType)
    lo0, hi0 = _range_bounds(df, column)
    lo = F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0)
    hi = F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0)
    idx = F.least(F.floor((v - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1))
    counts = df.where(v.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    width = (hi - lo) / F.lit(float(bins))
    return grid.join(counts, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"), (lo + F.col("bin") * width).alias("lower"),
        (lo + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


DENSITY_CELLS = 1 << 14    # cells of the weight grid: the error is below (cell / bandwidth)^2 / 8 of the density
DENSITY_REACH = 8.0        # bandwidths beyond which a Gaussian (1e-14 of its top) is left out


def density(df: DataFrame, column: str, gridsize: int = 200, cut: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian KDE on a ``gridsize`` grid, Scott bandwidth std·n^(-1/5),
    grid from min − cut·bw to max + cut·bw; of each group of ``keys``, where given.

    Linear binning: each value's weight is dealt to the two nearest of ``DENSITY_CELLS`` cells, an aggregate that
    Spark combines map-side, and the grid is convolved from the cells, so the work after the scan has a bound.
    A group without spread has no density and no rows."""
    v = as_double(column, df.schema[column].dataType)
    # NULL keys are groups: one struct compares null-safely
    group = F.struct(*[qcol(k) for k in keys]) if keys else F.lit(0)
    vals = df.select(group.alias("_g"), v.alias("_v")).where(F.col("_v").isNotNull())
    n, sd = F.count(F.lit(1)), F.stddev_samp("_v")
    stats = vals.groupBy("_g").agg(n.alias("_n"), (sd * F.pow(n.cast("double"), F.lit(-0.2))).alias("_bw"),
                                   F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where(F.col("_bw") > 0)
    bw, cell = F.col("_bw"), (F.col("_hi") - F.col("_lo")) / F.lit(float(DENSITY_CELLS))
    stats = stats.select("_g", "_n", "_bw", "_lo", cell.alias("_cell"), (F.col("_lo") - F.lit(cut) * bw).alias("_g0"),
                         ((F.col("_hi") - F.col("_lo") + F.lit(2 * cut) * bw) / F.lit(float(gridsize - 1))).alias("_step"))
    counts = vals.groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_w"))
    at = (F.col("_v") - F.col("_lo")) / F.col("_cell")
    low = F.least(F.floor(at), F.lit(DENSITY_CELLS - 1))
    part = at - low
    dealt = counts.join(stats if keys else F.broadcast(stats), "_g").select("_g", F.inline(F.array(
        F.struct(low.alias("_c"), (F.col("_w") * (F.lit(1.0) - part)).alias("_w")), F.struct((low + 1).alias("_c"), (F.col("_w") * part).alias("_w")))))
    cells = dealt.groupBy("_g", "_c").agg(F.sum("_w").alias("_w")).where(F.col("_w") > 0)
    center = F.col("_lo") + F.col("_c") * F.col("_cell")
    first = F.greatest(F.ceil((center - F.lit(DENSITY_REACH) * bw - F.col("_g0")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((center + F.lit(DENSITY_REACH) * bw - F.col("_g0")) / F.col("_step")), F.lit(gridsize - 1))
    near = cells.join(stats if keys else F.broadcast(stats), "_g").where(first <= last).select(
        "_g", "_w", center.alias("_x"), "_g0", "_step", "_bw", F.explode(F.sequence(first, last)).alias("i"))
    z = (F.col("_g0") + F.col("i") * F.col("_step") - F.col("_x")) / bw
    summed = near.groupBy("_g", "i").agg(F.sum(F.col("_w") * F.exp(F.lit(-0.5) * z * z)).alias("_s"))
    grid = stats.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(gridsize - 1).cast("bigint"))).alias("i"))
    return grid.join(summed, ["_g", "i"], "left").select(
        *[F.col("_g")[k].alias(k) for k in keys], F.col("i").cast("int").alias("i"), (F.col("_g0") + F.col("i") * F.col("_step")).alias("x"),
        (F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * bw * F.lit((2 * 3.141592653589793) ** 0.5))).alias("density"))


def grouped_histogram(df: DataFrame, column: str, keys: Sequence[str], bins: int = 30) -> DataFrame:
    """A17 of each group of ``keys``: (keys, bin, lower, upper, count), all ``bins`` rows of every group."""
    v = as_double(column, df.schema[column].dataType)
    vals = df.select(F.struct(*[qcol(k) for k in keys]).alias("_g"), v.alias("_v")).where(F.col("_v").isNotNull())
    ends = vals.groupBy("_g").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ends = ends.select("_g", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
                       F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    index = F.least(F.floor((F.col("_v") - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))), F.lit(bins - 1))
    counts = vals.join(ends, "_g").groupBy("_g", index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["_g", "bin"], "left").select(
        *[F.col("_g")[k].alias(k) for k in keys], "bin", (F.col("_lo") + F.col("bin") * width).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def crosstab(df: DataFrame, row_col: str, col_col: str, values: Sequence | None = None) -> DataFrame:
    """Counts of ``row_col`` × ``col_col`` (rows with a NULL in either are skipped), zeros filled.

    Pass ``values`` to fix the output columns; otherwise Spark discovers them (bounded by
    ``spark.sql.pivotMaxValues``)."""
    src = df.where(qcol(row_col).isNotNull() & qcol(col_col).isNotNull())
    g = src.groupBy(qcol(row_col))
    piv = g.pivot(col_col, list(values)) if values is not None else g.pivot(col_col)
    out = piv.count()
    return out.fillna(0, subset=[c for c in out.columns if c != row_col])


def box_stats(df: DataFrame, value_col: str, group_col: str, k: float = 1.5) -> DataFrame:
    """Per group n, quartiles (linear), IQR fences, whiskers (extreme values inside the
    fences) and number of points outside them."""
    v = as_double(value_col, df.schema[value_col].dataType)
    long = df.select(qcol(group_col).alias("grp"), v.alias("value"))
    counts = value_counts(long, ["grp"], "value")
    q = exact_quantiles_from_counts(counts, ["grp"], "value", [0.25, 0.5, 0.75])
    qs = q.groupBy("grp").agg(F.first("n").alias("n"),
                              *[F.max(F.when(F.col("p") == p, F.col("q"))).alias(nm)
                                for nm, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    qs = qs.select("*", (F.col("q3") - F.col("q1")).alias("iqr")).select(
        "*", (F.col("q1") - k * F.col("iqr")).alias("lower_fence"),
        (F.col("q3") + k * F.col("iqr")).alias("upper_fence"))
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    fences = qs.select(F.col("grp").alias("_g"), "lower_fence", "upper_fence")
    wh = counts.join(fences, counts["grp"].eqNullSafe(fences["_g"])).groupBy("grp").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("w")).otherwise(F.lit(0))).alias("n_outliers"))
    wh = wh.withColumnRenamed("grp", "_g")
    return qs.join(wh, qs["grp"].eqNullSafe(wh["_g"])).select(
        F.col("grp").alias(group_col), "n", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
        "whisker_low", "whisker_high", "n_outliers")


def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None,
                   max_points: int | None = None, seed: int = 42, key: str | None = None) -> DataFrame:
    """(x, y, color) pairs; with ``max_points`` a deterministic hash sample of that size
    (sampling is the feature; the default returns every row)."""
    cols = [qcol(x).alias("x"), qcol(y).alias("y"),
            (qcol(color) if color else F.lit(None)).alias("color")]
    out = df.select(*cols)
    if max_points is not None:
        h = F.xxhash64(F.lit(seed), *([qcol(key)] if key else [qcol(c) for c in df.columns]))
        out = df.select(*cols, h.alias("_h")).orderBy("_h").limit(max_points).drop("_h")
    return out


def skewness(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 1.0) -> DataFrame:
    """Bias-corrected sample skewness G1 = g1·√(n(n−1))/(n−2) per numeric column and
    the alert flag |G1| > ``limit``."""
    nl = numeric_long(df, columns)
    s = nl.groupBy("col_name").agg(F.count("value").alias("n"), F.skewness("value").alias("g1"))
    n = F.col("n").cast("double")
    g = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    return s.select("col_name", "n", g.alias("skew"), F.coalesce(F.abs(g) > limit, F.lit(False)).alias("skewed"))


def target_stats(df: DataFrame, column: str) -> DataFrame:
    """Min, max, mean, std (ddof 1) and range of a numeric target."""
    v = as_double(column, df.schema[column].dataType)
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                  F.stddev_samp(v).alias("std")).select("*", (F.col("max") - F.col("min")).alias("range"))


def eda_findings(df: DataFrame) -> DataFrame:
    """(finding, col_name, value): any null cell, any duplicate row, each skewed column."""
    m = basic_metrics(df).select("null_cells", "duplicate_rows")
    head = m.select(F.inline(F.array(
        F.when(F.col("null_cells") > 0, F.struct(F.lit("has_nulls").alias("finding"),
                                                 F.lit(None).cast("string").alias("col_name"),
                                                 F.col("null_cells").cast("double").alias("value"))),
        F.when(F.col("duplicate_rows") > 0, F.struct(F.lit("has_duplicates").alias("finding"),
                                                     F.lit(None).cast("string").alias("col_name"),
                                                     F.col("duplicate_rows").cast("double").alias("value"))),
    ))).where(F.col("finding").isNotNull())
    sk = skewness(df).where("skewed").select(F.lit("skewed").alias("finding"), "col_name",
                                             F.col("skew").alias("value"))
    return head.unionByName(sk)


def quality_bundle(df: DataFrame, vp: DataFrame | None = None) -> dict[str, DataFrame]:
    """The profiling tables persisted for the report, by section name, from one value profile."""
    vp = vp if vp is not None else value_profile(df)
    return {
        "global": quality_score(df, vp=vp),
        "nulls": nulls_by_column(df),
        "duplicates": duplicate_summary(df),
        "outliers": outliers(df, "iqr", 1.5, vp=vp),
        "columns": column_stats(df, vp),
    }


def write_quality_bundle(df: DataFrame, path: str, run_id: str) -> None:
    """Write every section as JSON rows into one ``quality`` dataset partitioned by section.  The value profile
    is computed once and kept until the sections are written."""
    vp = value_profile(df).persist(StorageLevel.MEMORY_AND_DISK)
    parts = [t.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("section"),
                      F.to_json(F.struct(*[qcol(c) for c in t.columns])).alias("payload"))
             for name, t in quality_bundle(df, vp).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    try:
        out.write.mode("append").partitionBy("run_id", "section").parquet(path)
    finally:
        vp.unpersist()


def load_validation(df: DataFrame) -> DataFrame:
    """A5: load-time validation as a long table (check, col_name, value): empty input, fully
    empty rows, each column with nulls (count), duplicate rows, and the inferred type of every
    column.  One aggregate for the counts plus the duplicate group-by."""
    cols = df.columns
    nb = nulls_by_column(df).where(F.col("nulls") > 0).select(
        F.lit("nulls").alias("check"), "col_name", F.col("nulls").cast("string").alias("value"))
    m = merge_single_rows(empty_rows(df), duplicate_count(df), df.agg(F.count(F.lit(1)).alias("_n")))
    head = m.select(F.inline(F.array(
        F.struct(F.lit("empty").alias("check"), F.lit(None).cast("string").alias("col_name"),
                 (F.col("_n") == 0).cast("string").alias("value")),
        F.struct(F.lit("empty_rows").alias("check"), F.lit(None).cast("string").alias("col_name"),
                 F.col("empty_rows").cast("string").alias("value")),
        F.struct(F.lit("duplicates").alias("check"), F.lit(None).cast("string").alias("col_name"),
                 F.col("duplicate_rows").cast("string").alias("value")))))
    types = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit("dtype").alias("check"), F.lit(c).alias("col_name"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("value")) for c in cols])))
    return head.unionByName(nb).unionByName(types)


# --------------------------------------------------------------------------- one-pass value profile
VALUE_STRUCT = "struct<l:bigint,d:double,s:string,t:timestamp_ntz,b:boolean>"


def _typed_value(name: str, dtype) -> Column:
    """A column's value as struct<l, d, s, t, b> (only the field of its type set); NULL when
    the value is missing (NULL or NaN).  Integral values keep 64-bit precision."""
    from pyspark.sql import types as T
    c = qcol(name)
    none = F.lit(None)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        f = dict(l=c.cast("bigint"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        f = dict(d=clean_value(name, dtype).cast("double"))
    elif is_datetime(dtype):
        f = dict(t=c.cast("timestamp_ntz"))
    elif isinstance(dtype, T.BooleanType):
        f = dict(b=c)
    elif is_text(dtype):
        f = dict(s=c.cast("string"))
    else:
        f = dict(s=F.to_json(F.struct(c.alias("v"))))
    st = F.struct(f.get("l", none).cast("bigint").alias("l"), f.get("d", none).cast("double").alias("d"),
                  f.get("s", none).cast("string").alias("s"), f.get("t", none).cast("timestamp_ntz").alias("t"),
                  f.get("b", none).cast("boolean").alias("b"))
    return F.when(missing(c, dtype), F.lit(None).cast(VALUE_STRUCT)).otherwise(st)


def value_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_name, value, w): every value of every column with its multiplicity, NULL value =
    missing — one scan and one map-side-combined shuffle for the whole table.

    Null counts, distinct counts, top values, moments, exact quantiles and outlier counts
    all derive from this (much smaller) table instead of re-reading the data."""
    cols = list(columns or df.columns)
    long = long_form(df, [], {c: _typed_value(c, df.schema[c].dataType) for c in cols})
    return long.groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("w"))


def profile_counts(vp: DataFrame) -> DataFrame:
    """(col_name, n_rows, nulls, n_distinct) from a value profile."""
    return vp.groupBy("col_name").agg(F.sum("w").alias("n_rows"),
                                      F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("w"))), F.lit(0)).alias("nulls"),
                                      F.count("value").alias("n_distinct"))


def profile_numeric(vp: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(col_name, value double, w) of the numeric columns (non-missing) from a value profile."""
    v = F.coalesce(F.col("value.l").cast("double"), F.col("value.d"))
    return vp.where(F.col("col_name").isin(list(numeric)) & F.col("value").isNotNull()) \
             .select("col_name", v.alias("value"), "w")


def _moments(counts: DataFrame) -> DataFrame:
    """(col_name, n, mean, std ddof 1, min, max) from (col_name, value, w): mean first, then
    centred squares (two aggregates over the small counts table)."""
    m = counts.groupBy("col_name").agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))
    dev = counts.join(m.select("col_name", F.col("mean").alias("_m")), "col_name") \
                .groupBy("col_name").agg(F.sum(F.col("w") * (F.col("value") - F.col("_m")) ** 2).alias("_ss"))
    return m.join(dev, "col_name").select(
        "col_name", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).alias("std"), "min", "max")
