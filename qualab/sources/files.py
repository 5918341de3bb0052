"""CSV / Parquet scans, load metadata, empty-input guard, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualab.functions.columns import normalize_nan


def read_csv(spark: SparkSession, path: str, header: bool = True, infer_schema: bool = True,
             sep: str = ",", encoding: str = "UTF-8", schema=None, **options) -> DataFrame:
    """CSV scan with header and inferred (or explicit) types; extra reader options pass
    through.  Malformed rows are kept as NULL fields (PERMISSIVE).  Give an explicit schema at
    scale: inference is an extra pass over the files."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding) \
                  .option("mode", "PERMISSIVE")
    for k, v in options.items():
        reader = reader.option(k, v)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer_schema)
    return normalize_nan(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_metadata(df: DataFrame, origin: str = "csv") -> DataFrame:
    """One row per column: position, name, type, plus the table's row / column counts and
    the source files it was read from.  The row count is one aggregate."""
    n = df.agg(F.count(F.lit(1))).scalar()
    files = F.array_sort(F.array(*[F.lit(p) for p in df.inputFiles()])) if df.inputFiles() else \
        F.array().cast("array<string>")
    cols = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("col_name"),
                     F.lit(f.dataType.simpleString()).alias("dtype"))
            for i, f in enumerate(df.schema.fields)]
    base = df.sparkSession.range(1).select(F.inline(F.array(*cols)))
    return base.select("position", "col_name", "dtype", n.alias("n_rows"),
                       F.lit(len(df.columns)).alias("n_columns"), F.lit(origin).alias("origin"),
                       files.alias("files"))


def guard_empty(df: DataFrame) -> tuple[DataFrame | None, dict | None]:
    """S3: (frame, None) or (None, error record) when the input has no rows or no columns —
    an error record instead of an exception.  ``isEmpty`` reads at most one row."""
    if not df.columns:
        return None, {"error": "empty_input", "detail": "no columns"}
    if df.isEmpty():
        return None, {"error": "empty_input", "detail": "no rows"}
    return df, None


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order (a top-k, not a full sort)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def schema_table(df: DataFrame) -> list[tuple[str, str]]:
    """(column, type) pairs."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread an under-partitioned input over the cluster.

    A scan of one large file with a single row group is one task, so every map-side step
    (unpivots, partial aggregates) would run on one core.  When the scan has fewer partitions
    than ``min_partitions`` (default: the cluster's default parallelism) the rows are
    round-robin repartitioned once; a normally split input (many files or row groups) is left
    untouched, so at scale this adds nothing."""
    try:
        target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the plan as it is
        return df
    return df.repartition(target) if current < target else df
