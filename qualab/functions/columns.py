"""Schema predicates and null normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric in the profiling sense: Boolean is *not* numeric."""
    return isinstance(dtype, NUMERIC_TYPES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def kind_of(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if is_text(dtype):
        return "text"
    if is_datetime(dtype):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def missing(c: Column | str, dtype: T.DataType) -> Column:
    """NULL, and NaN for floating columns, both count as missing."""
    col = F.col(c) if isinstance(c, str) else c
    if is_float(dtype):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def clean_value(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into NULL (and -0.0 into 0.0) for floating types."""
    col = F.col(name)
    if is_float(dtype):
        return F.when(F.isnan(col), F.lit(None).cast(dtype)).otherwise(col + F.lit(0.0).cast(dtype))
    return col


def normalize_nan(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (one projection)."""
    exprs = [clean_value(f.name, f.dataType).alias(f.name) if is_float(f.dataType) else F.col(f.name)
             for f in df.schema.fields]
    return df.select(*exprs)


def as_double(name: str, dtype: T.DataType) -> Column:
    """Numeric value as double with NaN → NULL; datetimes as epoch seconds."""
    if is_datetime(dtype):
        return epoch_seconds(F.col(name)).cast("double")
    return clean_value(name, dtype).cast("double")


def as_text(name: str, dtype: T.DataType) -> Column:
    """Stable textual form of a value, used to count distinct values of mixed-type columns."""
    return clean_value(name, dtype).cast("string")


def qcol(name: str) -> Column:
    """Column reference that tolerates dots and spaces in names."""
    return F.col(f"`{name}`")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970-01-01 00:00 of a wall-clock timestamp, independent of the session
    time zone (days since the epoch plus the time of day; fractions of a second included)."""
    t = ts.cast("timestamp_ntz")
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t) + \
        (F.date_format(t, "SSSSSS").cast("long") / F.lit(1e6))
