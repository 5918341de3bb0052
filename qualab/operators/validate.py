"""Validation rules: target checks, type suggestions, date checks, problem-type detection.

Each rule set is one aggregate over the table (or over a long (column, value) form) and
returns rule rows; the first-failing-rule logic is a ``when`` chain over that single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualab.functions.columns import epoch_seconds, is_datetime, is_numeric, is_text, missing, qcol
from qualab.functions.parsing import (DATE_LIKE_FORMATS, DATE_LIKE_PREFIXES, DATE_NAME_WORDS,
                                      STRICT_NUMBER, format_regex, java_pattern)
from qualab.functions.shape import long_form
from qualab.operators.profile import distinct_counts
from qualab.operators.transform import default_parse

# Thresholds of the reference rules.
TARGET_MAX_NULL_PCT = 20.0
MAX_CLASSES = 10
MIN_CLASS_SHARE = 0.01
TRAINING_DATE_REGEX = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}[-/]\d{1,2}[-/]\d{2}"


def _rule(valid: Column | bool, rule: str, value: Column | None = None) -> Column:
    return F.struct((valid if isinstance(valid, Column) else F.lit(valid)).alias("valid"),
                    F.lit(rule).alias("rule"),
                    (value if value is not None else F.lit(None)).cast("double").alias("value"))


def validate_target(df: DataFrame, target: str, problem_type: str) -> DataFrame:
    """V1: one row (valid, rule, value, null_pct); the first failing rule wins.

    Rules: column exists; NULL share > 20 % fails (≤ 20 % only warns, ``null_pct`` > 0);
    regression: numeric and not constant; classification: 2..10 classes and the smallest
    class ≥ 1 % of the non-null rows."""
    spark = df.sparkSession
    if target not in df.columns:
        return spark.range(1).select(F.lit(False).alias("valid"), F.lit("missing_column").alias("rule"),
                                     F.lit(None).cast("double").alias("value"),
                                     F.lit(None).cast("double").alias("null_pct"))
    dtype = df.schema[target].dataType
    c = qcol(target)
    base = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing(c, dtype)).alias("nulls"))
    null_pct = F.try_divide(F.col("nulls").cast("double"), F.col("n").cast("double")) * 100.0
    if problem_type == "regresion":
        if not is_numeric(dtype):
            verdict = F.when(null_pct > TARGET_MAX_NULL_PCT, _rule(False, "too_many_nulls", null_pct)) \
                       .otherwise(_rule(False, "not_numeric"))
            return base.select(verdict.alias("r"), null_pct.alias("null_pct")).select("r.*", "null_pct")
        v = F.when(~F.isnan(c.cast("double")), c.cast("double"))
        stats = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing(c, dtype)).alias("nulls"),
                       F.min(v).alias("mn"), F.max(v).alias("mx"))
        verdict = (F.when(null_pct > TARGET_MAX_NULL_PCT, _rule(False, "too_many_nulls", null_pct))
                   .when(F.col("mn").isNull() | (F.col("mn") == F.col("mx")), _rule(False, "constant"))
                   .otherwise(_rule(True, "valid")))
        return stats.select(verdict.alias("r"), null_pct.alias("null_pct")).select("r.*", "null_pct")
    # classification: class counts (map-side combined), then one row
    nonnull = df.where(~missing(c, dtype))
    classes = nonnull.groupBy(c.alias("_k")).agg(F.count(F.lit(1)).alias("_w")) \
                     .agg(F.count(F.lit(1)).alias("k"), F.min("_w").alias("wmin"), F.sum("_w").alias("wsum"))
    from qualab.functions.shape import merge_single_rows
    one = merge_single_rows(base, classes)
    share = F.col("wmin") / F.col("wsum")
    verdict = (F.when(null_pct > TARGET_MAX_NULL_PCT, _rule(False, "too_many_nulls", null_pct))
               .when(F.coalesce(F.col("k"), F.lit(0)) <= 1, _rule(False, "single_class", F.col("k")))
               .when(F.col("k") > MAX_CLASSES, _rule(False, "too_many_classes", F.col("k")))
               .when(share < MIN_CLASS_SHARE, _rule(False, "rare_class", share * 100.0))
               .otherwise(_rule(True, "valid")))
    return one.select(verdict.alias("r"), null_pct.alias("null_pct")).select("r.*", "null_pct")


def validate_structure(df: DataFrame, config: dict) -> DataFrame:
    """V2: configuration complete → target rules (V1) → every predictor exists."""
    spark = df.sparkSession
    ptype, target, preds = config.get("tipo_problema"), config.get("variable_objetivo"), \
        config.get("variables_predictoras") or []

    def literal(valid: bool, rule: str) -> DataFrame:
        return spark.range(1).select(F.lit(valid).alias("valid"), F.lit(rule).alias("rule"),
                                     F.lit(None).cast("double").alias("value"),
                                     F.lit(None).cast("double").alias("null_pct"))
    if not ptype or not target or not preds:
        return literal(False, "incomplete_config")
    t = validate_target(df, target, ptype)
    missing_preds = [p for p in preds if p not in df.columns]
    fail = F.lit(f"missing_predictor:{missing_preds[0]}") if missing_preds else None
    if fail is None:
        return t
    return t.select(F.col("valid") & F.lit(False), F.when(F.col("valid"), fail).otherwise(F.col("rule")),
                    "value", "null_pct").toDF("valid", "rule", "value", "null_pct")


def categorical_numeric_columns(df: DataFrame, max_distinct: int = 10, max_ratio: float = 0.05) -> DataFrame:
    """V3: numeric columns that look categorical (1 < distinct ≤ 10 and distinct/rows < 0.05)."""
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if not num:
        return df.sparkSession.createDataFrame([], "col_name string, n_distinct bigint, ratio double, flagged boolean")
    n = df.agg(F.count(F.lit(1))).scalar()
    d = distinct_counts(df, num)
    ratio = d["n_distinct"] / n
    return d.select("col_name", "n_distinct", ratio.alias("ratio"),
                    ((F.col("n_distinct") > 1) & (F.col("n_distinct") <= max_distinct) & (ratio < max_ratio)).alias("flagged"))


def possible_date(c: Column) -> Column:
    """V6: the text starts with a date-like pattern (case-insensitive), or parses whole with
    one of the accepted formats."""
    s = c.cast("string")
    pref = s.rlike("(?i)^(?:" + "|".join(DATE_LIKE_PREFIXES) + ")")
    parsed = F.coalesce(*[F.when(s.rlike(format_regex(f)), F.try_to_timestamp(s, F.lit(java_pattern(f, parse=True))))
                          for f in DATE_LIKE_FORMATS])
    return F.coalesce(pref, F.lit(False)) | parsed.isNotNull()


def text_type_suggestions(df: DataFrame, columns: Sequence[str] | None = None,
                          min_date_share: float = 1.0) -> DataFrame:
    """V4 + V5 per text column: n non-null, n numeric, n date-like and the two suggestions.

    ``numeric_text`` needs every non-null value to be a plain number and (as in the reference,
    where a text column with missing values is not a string column) no missing value.
    ``date_text`` needs ``min_date_share`` of the non-null values to look like dates."""
    cols = [c for c in (columns or [f.name for f in df.schema.fields if is_text(f.dataType)])]
    long = long_form(df, [], {c: qcol(c).cast("string") for c in cols})
    agg = long.groupBy("col_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n"),
        F.count_if(F.col("value").rlike(STRICT_NUMBER)).alias("n_numeric"),
        F.count_if(F.col("value").isNotNull() & possible_date(F.col("value"))).alias("n_date"))
    return agg.select(
        "col_name", "n", "n_numeric", "n_date",
        ((F.col("n") > 0) & (F.col("n") == F.col("n_rows")) & (F.col("n_numeric") == F.col("n"))).alias("numeric_text"),
        ((F.col("n") > 0) & (F.col("n_date") >= F.col("n") * min_date_share)).alias("date_text"))


def date_candidates(df: DataFrame) -> list[str]:
    """V7: datetime columns, then columns whose name contains a date word."""
    out = [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    for c in df.columns:
        if c not in out and any(w in c.lower() for w in DATE_NAME_WORDS):
            out.append(c)
    return out


def date_rules(df: DataFrame, columns: Sequence[str] | None = None, as_of: str = "2025-01-01") -> DataFrame:
    """V8: per candidate date column the rule rows (col_name, rule, value).

    ``as_of`` replaces "now" so results are reproducible."""
    cols = list(columns) if columns is not None else date_candidates(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, rule string, value double")
    exprs = {c: (qcol(c).cast("timestamp_ntz") if is_datetime(df.schema[c].dataType) else default_parse(qcol(c)))
             for c in cols}
    long = long_form(df, [], exprs)
    secs = epoch_seconds(F.col("value"))
    agg = long.groupBy("col_name").agg(
        F.count(F.lit(1)).alias("total"), F.count("value").alias("valid"),
        F.count_distinct("value").alias("n_unique"),
        F.floor((F.max(secs) - F.min(secs)) / F.lit(86400)).alias("range_days"),
        F.count_if(F.col("value") > F.lit(as_of).cast("timestamp_ntz")).alias("n_future"))
    nulls = F.col("total") - F.col("valid")
    t = F.col("total")
    stop = nulls == t

    def r(cond: Column, name: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value")))

    rules = F.array(
        r(nulls > t * 0.2, "too_many_invalid", nulls),
        r(stop, "not_convertible", nulls),
        r(~stop & (F.col("n_unique") == t - nulls), "all_unique", F.col("n_unique")),
        r(~stop & (F.col("range_days") < 2), "low_range", F.col("range_days")),
        r(~stop & (F.col("n_future") > t * 0.5), "mostly_future", F.col("n_future")),
        r(~stop & (nulls < t * 0.2) & (F.col("n_unique") < t * 0.9) & (F.col("range_days") >= 2),
          "valid_derive_parts", F.col("range_days")),
    )
    return agg.select("col_name", F.inline(F.filter(rules, lambda x: x.isNotNull())))


def training_date_columns(df: DataFrame, exclude: Sequence[str] = (), share: float = 0.5) -> DataFrame:
    """V9: (col_name, is_date): datetime type, or at least ``share`` of all non-null values begin
    with a date-like pattern.  One aggregate over all text columns."""
    fields = [f for f in df.schema.fields if f.name not in exclude and (is_datetime(f.dataType) or is_text(f.dataType))]
    if not fields:
        return df.sparkSession.createDataFrame([], "col_name string, is_date boolean")
    aggs, rows = [], []
    for i, f in enumerate(fields):
        if is_datetime(f.dataType):
            rows.append(F.struct(F.lit(f.name).alias("col_name"), F.lit(True).alias("is_date")))
        else:
            c = qcol(f.name)
            aggs.append(F.avg(c.rlike("^(?:" + TRAINING_DATE_REGEX + ")").cast("double")).alias(f"s{i}"))
            rows.append(F.struct(F.lit(f.name).alias("col_name"), F.coalesce(F.col(f"s{i}") >= share, F.lit(False)).alias("is_date")))
    return df.agg(F.count(F.lit(1)).alias("_n"), *aggs).select(F.inline(F.array(*rows)))


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """V10: 'clasificacion' for text/boolean targets or few distinct values (distinct counting
    NULL as a value: ratio < 0.05 or fewer than 10), else 'regresion'."""
    dtype = df.schema[target].dataType
    c = qcol(target)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(c).alias("nd"),
                 F.max(F.when(c.isNull(), 1).otherwise(0)).alias("has_null"))
    nd = F.col("nd") + F.coalesce(F.col("has_null"), F.lit(0))
    ratio = F.try_divide(nd.cast("double"), F.col("n").cast("double"))
    if not is_numeric(dtype):
        kind = F.lit("clasificacion")
    else:
        kind = F.when((ratio < 0.05) | (nd < 10), F.lit("clasificacion")).otherwise(F.lit("regresion"))
    return agg.select(F.lit(target).alias("col_name"), kind.alias("problem_type"), nd.cast("bigint").alias("n_distinct"),
                      ratio.alias("ratio"))


def categorical_for_plots(df: DataFrame, target: str) -> DataFrame:
    """The target is treated as categorical when it is text or has fewer than 10 values."""
    c = qcol(target)
    txt = is_text(df.schema[target].dataType)
    return df.agg(F.count_distinct(c).alias("n_distinct")).select(
        F.lit(target).alias("col_name"), "n_distinct",
        (F.lit(txt) | (F.col("n_distinct") < 10)).alias("categorical"))
