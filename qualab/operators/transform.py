"""Column transforms: type correction, date standardisation, date parts, unit conversion.

Every transform is a projection (``withColumn``) of native expressions, so a chain of
corrections collapses into one whole-stage-codegen stage.  Where the reference picks a
format or unit from the data, the choice is made by one small aggregate (a handful of
numbers) and the rows are never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualab.functions.columns import epoch_seconds, is_datetime, is_numeric, is_text, qcol
from qualab.functions.parsing import (BARE_NUMBER, DATE_FORMATS, DATE_OUTPUTS, DATE_PATTERNS,
                                      FALSE_WORDS, FIRST_DECIMAL, FIRST_DIGITS, NUMBER_WITH_UNIT,
                                      NUMERIC_CONVERSIONS, STRICT_NUMBER, TEMPERATURE_WORDS,
                                      TRUE_WORDS, UNIT_FACTORS, format_regex, java_pattern)


# --------------------------------------------------------------------------- scalar builders
def strict_double(c: Column) -> Column:
    """Text → double only when the whole text is a plain number (``'12d'`` and ``'NaN'`` → NULL)."""
    s = c.cast("string")
    return F.when(s.rlike(STRICT_NUMBER), F.trim(s).try_cast("double"))


def int_expr(c: Column, dtype: T.DataType, method: str = "auto", on_fraction: str = "null") -> Column:
    """T1/T2 expression: integer (bigint) value of ``c``."""
    if method == "force":
        return F.regexp_extract(c.cast("string"), FIRST_DIGITS, 1).try_cast("bigint")
    d = c.cast("double") if is_numeric(dtype) else strict_double(c)
    whole = d == F.floor(d)
    if on_fraction == "error":
        return F.when(d.isNull(), F.lit(None).cast("bigint")).when(
            whole, d.try_cast("bigint")).otherwise(F.raise_error(F.lit("fractional value cannot become integer")).cast("bigint"))
    return F.when(whole, d.try_cast("bigint"))


def float_expr(c: Column, dtype: T.DataType, method: str = "auto") -> Column:
    """T3/T4 expression: double value of ``c``."""
    if method == "force":
        return F.regexp_extract(c.cast("string"), FIRST_DECIMAL, 1).try_cast("double")
    return c.cast("double") if is_numeric(dtype) else strict_double(c)


def bool_expr(c: Column, dtype: T.DataType, method: str = "standard") -> Column:
    """T6/T7 expression.  ``standard``: non-empty text is true (even the word 'False'), missing
    text false, numbers true unless 0 (missing numbers are NaN, which is true).
    ``infer``: boolean words (after lower/trim), anything else NULL."""
    if method == "infer":
        w = F.lower(F.trim(c.cast("string")))
        return F.when(w.isin(TRUE_WORDS), F.lit(True)).when(w.isin(FALSE_WORDS), F.lit(False))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if is_numeric(dtype):
        return F.coalesce(c != 0, F.lit(True))
    return F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))


# --------------------------------------------------------------------------- T1-T7, T9
def correct_type(df: DataFrame, column: str, target: str, method: str = "auto",
                 on_fraction: str = "null") -> DataFrame:
    """Convert ``column`` to int / float / str / bool / datetime in place.

    ``method``: ``auto`` (strict parse, invalid → NULL), ``force`` (extract the first number),
    ``infer`` (boolean words).  Text results keep NULL as NULL (pandas writes 'nan').
    """
    if column not in df.columns:
        raise ValueError(f"column {column!r} does not exist")
    c, dtype = qcol(column), df.schema[column].dataType
    if target == "int":
        expr = int_expr(c, dtype, method, on_fraction)
    elif target == "float":
        expr = float_expr(c, dtype, method)
    elif target == "str":
        expr = c.cast("string")
    elif target == "bool":
        expr = bool_expr(c, dtype, "infer" if method == "infer" else "standard")
    elif target == "datetime":
        return standardize_dates(df, column, "ISO")
    else:
        raise ValueError(f"unsupported target type {target!r}")
    return df.withColumn(column, expr)


def simple_cast(df: DataFrame, column: str, target: str) -> DataFrame:
    """Numerico → double, categorico → string, fecha → timestamp, texto → string;
    an unknown target leaves the column unchanged."""
    if column not in df.columns:
        raise ValueError(f"column {column!r} does not exist")
    c, dtype = qcol(column), df.schema[column].dataType
    if target == "numerico":
        return df.withColumn(column, float_expr(c, dtype))
    if target in ("categorico", "texto"):
        return df.withColumn(column, c.cast("string"))
    if target == "fecha":
        return standardize_dates(df, column, "datetime")
    return df


# --------------------------------------------------------------------------- dates
def _parse_with(c: Column, fmt: str) -> Column:
    """Parse with one format; the regex guard skips texts that cannot match (failed parses are
    the expensive path of a timestamp parser)."""
    return F.when(c.rlike(format_regex(fmt)),
                  F.try_to_timestamp(c, F.lit(java_pattern(fmt, parse=True)))).cast("timestamp_ntz")


def default_parse(c: Column) -> Column:
    """Lenient ISO-style parse (what a generic date parser accepts)."""
    return c.cast("string").try_cast("timestamp").cast("timestamp_ntz")


def choose_date_format(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS,
                       max_invalid: float = 0.3) -> str | None:
    """T10 format choice from one aggregate: ``None`` (the default parser) when it leaves at most
    ``max_invalid`` of the rows unparsed; else the first format below that share; else the
    format that parses most rows (ties: list order)."""
    s = qcol(column).cast("string")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(default_parse(s)).alias("d"),
                 *[F.count(_parse_with(s, f)).alias(f"f{i}") for i, f in enumerate(formats)]).first()
    n = row["n"]
    if n == 0 or (n - row["d"]) <= n * max_invalid:
        return None
    valid = [row[f"f{i}"] for i in range(len(formats))]
    for f, v in zip(formats, valid):
        if (n - v) < n * max_invalid:
            return f
    best = max(range(len(formats)), key=lambda i: (valid[i], -i))
    return formats[best]


def standardize_dates(df: DataFrame, column: str, target: str = "ISO",
                      formats: Sequence[str] = DATE_FORMATS, max_invalid: float = 0.3) -> DataFrame:
    """T10 (and T8): parse ``column`` with the chosen format and write it as ISO / DMY / MDY /
    YMD text, a custom strftime layout, or a timestamp (``target='datetime'``)."""
    c, dtype = qcol(column), df.schema[column].dataType
    if is_datetime(dtype):
        ts = c.cast("timestamp_ntz")
    else:
        fmt = choose_date_format(df, column, formats, max_invalid)
        ts = default_parse(c) if fmt is None else _parse_with(c.cast("string"), fmt)
    if target == "datetime":
        return df.withColumn(column, ts)
    layout = DATE_OUTPUTS.get(target, target)
    return df.withColumn(column, F.date_format(ts, java_pattern(layout)))


def standardize_dates_by_pattern(df: DataFrame, column: str, match_share: float = 0.9,
                                 min_valid: float = 0.7) -> DataFrame:
    """Datetime columns are truncated to the date; text columns take the first prefix
    pattern matched by ≥ ``match_share`` of the rows (else the default parser); if fewer than
    ``min_valid`` of the rows convert, the column is returned unchanged."""
    c, dtype = qcol(column), df.schema[column].dataType
    if is_datetime(dtype):
        return df.withColumn(column, F.to_date(c).cast("timestamp_ntz"))
    s = c.cast("string")
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(s.rlike("^" + p)).alias(f"m{i}") for i, (p, _) in enumerate(DATE_PATTERNS)]).first()
    n = row["n"]
    chosen = None
    for i, (_, fmt) in enumerate(DATE_PATTERNS):
        if n and row[f"m{i}"] >= match_share * n:
            chosen = fmt
            break
    ts = default_parse(s) if chosen is None else _parse_with(s, chosen)
    valid = df.agg(F.count(ts)).first()[0]
    if n == 0 or valid / n * 100 < min_valid * 100:
        return df
    return df.withColumn(column, ts)


DATE_PARTS = ["anio", "mes", "dia", "dia_semana", "nombre_dia", "nombre_mes", "dia_anio", "semana",
              "es_fin_de_semana", "fecha_epoch"]


def date_parts(df: DataFrame, column: str, parts: Sequence[str] | None = None) -> DataFrame:
    """Add ``{column}_{part}`` columns; a missing date gives NULL parts and weekend False."""
    c, dtype = qcol(column), df.schema[column].dataType
    ts = c.cast("timestamp_ntz") if is_datetime(dtype) else default_parse(c)
    d = F.to_date(ts)
    wd = F.weekday(d)
    exprs = {
        "anio": F.year(d), "mes": F.month(d), "dia": F.dayofmonth(d), "dia_semana": wd,
        "nombre_dia": F.date_format(d, "EEEE"), "nombre_mes": F.date_format(d, "MMMM"),
        "dia_anio": F.dayofyear(d), "semana": F.weekofyear(d),
        "es_fin_de_semana": F.coalesce(wd >= 5, F.lit(False)),
        "fecha_epoch": F.floor(epoch_seconds(ts)).cast("bigint"),
    }
    wanted = [p for p in (parts or DATE_PARTS) if p in exprs]
    return df.withColumns({f"{column}_{p}": exprs[p] for p in wanted})


def expand_dates(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "expand") -> DataFrame:
    """``expand`` each date column into ``_anio, _mes, _dia`` and drop it; ``drop`` the date
    columns; ``keep`` them."""
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    if mode == "keep":
        return df
    if mode == "drop":
        return df.drop(*cols)
    out = df
    for col in cols:
        ts = qcol(col).cast("timestamp_ntz") if is_datetime(df.schema[col].dataType) else default_parse(qcol(col))
        out = out.withColumns({f"{col}_anio": F.year(ts), f"{col}_mes": F.month(ts), f"{col}_dia": F.dayofmonth(ts)})
        out = out.drop(col)
    return out


# --------------------------------------------------------------------------- units
def dominant_unit(df: DataFrame, column: str) -> DataFrame:
    """The most common unit written after a number (ties: unit ascending), with its count."""
    u = F.regexp_extract(qcol(column).cast("string"), NUMBER_WITH_UNIT, 2)
    counts = df.select(u.alias("unit")).where(F.col("unit") != "").groupBy("unit").agg(F.count(F.lit(1)).alias("count"))
    best = F.min(F.struct((-F.col("count")).alias("nc"), F.col("unit").alias("u")))
    return counts.agg(best.alias("b")).where(F.col("b").isNotNull()) \
                 .select(F.col("b.u").alias("unit"), (-F.col("b.nc")).alias("count"))


def _apply_factor(x: Column, factor) -> Column:
    return factor(x) if callable(factor) else x * F.lit(float(factor))


def convert_units(df: DataFrame, column: str, target: str, source: str | None = None,
                  mode: str = "dominant") -> DataFrame:
    """Text values '<number> <unit>' converted to ``target``.

    ``mode='dominant'`` (reference behaviour) treats the whole column as the detected (or given)
    source unit; ``mode='per_row'`` converts each row from its own unit.  Adds ``{column}_value``
    (double) and ``{column}_unit`` and rewrites ``column`` as '<value> <target>'.
    """
    txt = qcol(column).cast("string")
    num = F.regexp_extract(txt, BARE_NUMBER, 1).try_cast("double")
    if mode == "per_row":
        unit = F.regexp_extract(txt, NUMBER_WITH_UNIT, 2)
        val = F.when(unit == target, num)
        for (a, b), f in UNIT_FACTORS.items():
            if b == target:
                val = val.when(unit == a, _apply_factor(num, f))
    else:
        if source is None:
            top = dominant_unit(df, column).first()
            if top is None:
                raise ValueError("could not detect the source unit")
            source = top["unit"]
        if (source, target) not in UNIT_FACTORS:
            raise ValueError(f"no conversion defined from {source} to {target}")
        val = _apply_factor(num, UNIT_FACTORS[(source, target)])
    return df.withColumns({
        f"{column}_value": val,
        f"{column}_unit": F.when(val.isNotNull(), F.lit(target)),
        column: F.concat(val.cast("string"), F.lit(" " + target)),
    })


def detect_temperature_unit(df: DataFrame, column: str) -> str | None:
    """T16 source-unit rule: only for names containing a temperature word, by value range."""
    if not any(w in column.lower() for w in TEMPERATURE_WORDS):
        return None
    row = df.agg(F.min(qcol(column)).alias("lo"), F.max(qcol(column)).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return None
    if 0 <= lo <= 50 and hi <= 50:
        return "celsius"
    if 32 <= lo <= 100 and hi <= 110:
        return "fahrenheit"
    if 273 <= lo <= 373:
        return "kelvin"
    return None


def convert_numeric_units(df: DataFrame, column: str, target: str, source: str | None = None) -> DataFrame:
    """Named conversion ``{source}_a_{target}`` on a numeric column; unknown pairs and
    non-numeric columns are returned unchanged."""
    if not is_numeric(df.schema[column].dataType):
        return df
    src = source or detect_temperature_unit(df, column)
    fn = NUMERIC_CONVERSIONS.get(f"{src}_a_{target}")
    if fn is None:
        return df
    return df.withColumn(column, fn(qcol(column).cast("double")))


# --------------------------------------------------------------------------- T17
def apply_corrections(df: DataFrame, corrections: Sequence[tuple[str, str, str]]
                      ) -> tuple[DataFrame, DataFrame]:
    """Apply (column, target, method) corrections in order; a failing correction is
    reported and skipped, the others still apply.  Returns (frame, report)."""
    out = df
    report = []
    for column, target, method in corrections:
        try:
            out = correct_type(out, column, target, method)
            report.append((column, target, method, True, None))
        except Exception as e:  # noqa: BLE001 - the failure is the reported result
            report.append((column, target, method, False, str(e).splitlines()[0][:200]))
    rep = df.sparkSession.createDataFrame(
        report, "col_name string, target string, method string, ok boolean, error string")
    return out, rep
