"""Deterministic, partition-independent row hashing for splits, folds and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualab.functions.columns import qcol


def row_key(cols: Sequence[str]) -> Column:
    """Text key of a row: the given columns joined by '|' (NULL written as empty)."""
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])


def hash_unit(key: Column, seed: int = 42) -> Column:
    """Uniform number in [0, 1) from md5(seed|key): the first 32 bits of the digest / 2^32.

    The same number is ``('0x' || substr(md5('<seed>|' || key), 1, 8))::UBIGINT / 2^32`` in
    DuckDB, so splits can be checked row by row.
    """
    h = F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}|"), key)), F.lit(1), F.lit(8)), 16, 10)
    return h.cast("double") / F.lit(float(2 ** 32))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """192 hashed bits of a row's values: rows that a group-by over ``columns`` would put together have the same
    (NULL = NULL, NaN = NaN, 0.0 = -0.0); of n other rows, two agree with probability below n^2 / 2^193."""
    values = []
    for c in columns:
        v, kind = qcol(c), df.schema[c].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            v = F.when(F.isnan(v), F.lit(float("nan")).cast(kind)).otherwise(v + F.lit(0.0).cast(kind))
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            v = F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})
        values += [v, v.isNull()]                  # the hash passes over a NULL, the flag keeps its place
    return F.struct(*[F.xxhash64(F.lit(seed), *values).alias(f"h{seed}") for seed in range(3)])


def group_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``_n`` for each group of rows that are alike in ``columns``.  Only fingerprints are shuffled."""
    return df.groupBy(fingerprint(df, columns).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
