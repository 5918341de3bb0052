"""Feature preparation: predictor selection, date expansion, category capping, one-hot,
imputation, hash split, scaling, label encoding.

Fitting steps compute a *bounded* state (per-column means, the ≤ 10 kept categories of a
column, class labels) with one aggregate and apply it as a projection; no row data reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualab.functions.columns import is_datetime, is_numeric, is_text, qcol
from qualab.functions.hashing import hash_unit, row_key
from qualab.operators.transform import default_parse

# Target-name guesses, category cap and its bucket label.
TARGET_NAMES = ["target", "objetivo", "y", "clase"]
MAX_CATEGORIES = 10
OTHER_LABEL = "OTROS"
# size bound for categories discovered from data (one column per category is created)
MAX_ONE_HOT = 1000


# --------------------------------------------------------------------------- P1-P5
def guess_target(df: DataFrame, target: str | None = None) -> str:
    """The given target, else the first column named like a target (case-insensitive)."""
    if target:
        if target not in df.columns:
            raise ValueError(f"target {target!r} not in the table")
        return target
    for c in df.columns:
        if c.lower() in TARGET_NAMES:
            return c
    raise ValueError("no target column given and none could be guessed")


def split_target(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictors, target) projections of the same table."""
    t = guess_target(df, target)
    return df.drop(t), df.select(qcol(t))


def select_predictors(df: DataFrame, predictors: Sequence[str] | None, target: str) -> DataFrame:
    """Keep the named predictors that exist and differ from the target; all when none remain."""
    keep = [c for c in (predictors or []) if c in df.columns and c != target]
    if not keep:
        keep = [c for c in df.columns if c != target]
    return df.select(*[qcol(c) for c in keep])


def candidate_targets(df: DataFrame, problem_type: str) -> list[str]:
    """Numeric columns for regression, every column for classification."""
    if problem_type == "regresion":
        return [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    return list(df.columns)


def align_columns(df: DataFrame, train_columns: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """reorder/select to the training columns; returns (frame, missing, extra).
    Missing columns are added as NULL so the model sees its full schema."""
    missing = [c for c in train_columns if c not in df.columns]
    extra = [c for c in df.columns if c not in train_columns]
    cols = [qcol(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in train_columns]
    return df.select(*cols), missing, extra


def all_null_columns(df: DataFrame) -> list[str]:
    """Columns with no value (one aggregate; the result is one number per column)."""
    row = df.agg(*[F.count(qcol(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"c{i}"] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """P5."""
    return df.drop(*all_null_columns(df))


def predictor_set_changed(runs: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Per run, whether its predictor array differs (as a set) from ``predictors``."""
    cur = F.array(*[F.lit(p) for p in predictors]) if predictors else F.array().cast("array<string>")
    return runs.select("run_id", F.array_except(F.col("predictors"), cur).alias("removed"),
                       F.array_except(cur, F.col("predictors")).alias("added")) \
               .select("run_id", "removed", "added",
                       ((F.size("removed") > 0) | (F.size("added") > 0)).alias("changed"))


# --------------------------------------------------------------------------- F2-F6
def top_categories(df: DataFrame, column: str, k: int = MAX_CATEGORIES) -> list:
    """The ``k`` most frequent values (ties: value ascending) when the column has more than
    ``k`` distinct values, else ``None`` (no capping).  The result has at most k values."""
    counts = df.where(qcol(column).isNotNull()).groupBy(qcol(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col("v")).limit(k + 1).collect()
    if len(top) <= k:
        return None
    return [r["v"] for r in top[:k]]


def cap_categories(df: DataFrame, column: str, k: int = MAX_CATEGORIES, other: str = OTHER_LABEL) -> DataFrame:
    """beyond ``k`` distinct values keep the ``k`` most frequent; the rest (NULL too) → ``other``."""
    top = top_categories(df, column, k)
    if top is None:
        return df
    return df.withColumn(column, F.when(qcol(column).isin(top), qcol(column)).otherwise(F.lit(other)))


def one_hot(df: DataFrame, column: str, categories: Sequence | None = None, drop_first: bool = True,
            dummy_na: bool = True, max_categories: int = MAX_ONE_HOT) -> DataFrame:
    """0/1 integer columns ``{column}_{value}`` for the sorted categories (first dropped) and
    ``{column}_nan`` for NULL; the source column is removed.  Categories come from the data
    (bounded after :func:`cap_categories`; more than ``max_categories`` are refused) unless given."""
    if categories is None:
        found = df.where(qcol(column).isNotNull()).select(qcol(column)).distinct() \
                  .orderBy(qcol(column)).limit(max_categories + 1).collect()
        if len(found) > max_categories:
            raise ValueError(f"{column} has more than {max_categories} categories; cap it first")
        categories = [r[0] for r in found]
    cats = sorted(categories)
    if drop_first and cats:
        cats = cats[1:]
    c = qcol(column)
    new = {f"{column}_{v}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in cats}
    if dummy_na:
        new[f"{column}_nan"] = c.isNull().cast("int")
    return df.withColumns(new).drop(column)


def numeric_only(df: DataFrame) -> DataFrame:
    """drop every column that is not numeric (booleans included)."""
    return df.select(*[qcol(f.name) for f in df.schema.fields if is_numeric(f.dataType)])


def finite_or_null(df: DataFrame) -> DataFrame:
    """±Inf and NaN → NULL in floating columns."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast(f.dataType))
                       .otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def impute_mean(df: DataFrame, fit_df: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """numeric columns (as double) with NULL → mean of ``fit_df`` (default: ``df`` itself), then 0."""
    cols = list(columns or [f.name for f in df.schema.fields if is_numeric(f.dataType)])
    means = column_means(fit_df if fit_df is not None else df, cols)
    return df.withColumns({c: F.coalesce(qcol(c).cast("double"), F.lit(means[c]).cast("double"), F.lit(0.0))
                           for c in cols})


# --------------------------------------------------------------------------- F1, J1
def _date_like_columns(df: DataFrame, max_invalid: float = 0.3, keep: Sequence[str] = ()) -> list[str]:
    """Columns F1 expands into date parts: datetime columns, and text columns of which less than
    ``max_invalid`` of all rows do not parse as dates (one aggregate for all columns)."""
    fields = [f for f in df.schema.fields if f.name not in keep]
    texts = [f.name for f in fields if is_text(f.dataType)]
    good = set()
    if texts:
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(default_parse(qcol(c))).alias(f"p{i}") for i, c in enumerate(texts)]).first()
        good = {c for i, c in enumerate(texts) if row[f"p{i}"] and row["n"] - row[f"p{i}"] < max_invalid * row["n"]}
    return [f.name for f in fields if is_datetime(f.dataType) or f.name in good]


def _expand(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = df
    for name in cols:
        c = qcol(name)
        ts = c.cast("timestamp_ntz") if is_datetime(df.schema[name].dataType) else default_parse(c)
        out = out.withColumns({f"{name}_anio": F.year(ts), f"{name}_mes": F.month(ts),
                               f"{name}_dia": F.dayofmonth(ts)}).drop(name)
    return out


def fit_ml_prep(df: DataFrame, keep: Sequence[str] = (), max_categories: int = MAX_CATEGORIES,
                max_invalid: float = 0.3) -> dict:
    """F1 fitted state from ``df``: the date columns to expand and, per text column, the kept
    categories (``max_categories`` + 'OTROS') and the one-hot categories.  All of it is bounded in size."""
    dates = _date_like_columns(df, max_invalid, keep)
    texts = {}
    for f in df.schema.fields:
        if f.name in keep or f.name in dates or not is_text(f.dataType):
            continue
        top = top_categories(df, f.name, max_categories)
        if top is None:
            cats = [r[0] for r in df.where(qcol(f.name).isNotNull()).select(qcol(f.name)).distinct()
                    .orderBy(qcol(f.name)).collect()]
        else:
            cats = sorted(set(top) | {OTHER_LABEL})
        texts[f.name] = (top, cats)
    return {"dates": dates, "texts": texts}


def apply_ml_prep(df: DataFrame, state: dict, keep: Sequence[str] = ()) -> DataFrame:
    """F1 projection with a fitted state (no imputation)."""
    keep = list(keep)
    out = _expand(df, [c for c in state["dates"] if c in df.columns])
    for name, (top, cats) in state["texts"].items():
        if name not in out.columns:
            continue
        if top is not None:
            out = out.withColumn(name, F.when(qcol(name).isin(top), qcol(name)).otherwise(F.lit(OTHER_LABEL)))
        out = one_hot(out, name, cats)
    feats = [f.name for f in out.schema.fields if is_numeric(f.dataType) and f.name not in keep]
    out = finite_or_null(out.select(*[qcol(c) for c in keep], *[qcol(c) for c in feats]))
    return out.select(*[qcol(c) for c in keep], *[qcol(c).cast("double").alias(c) for c in feats])


def prepare_for_ml(df: DataFrame, fit_df: DataFrame | None = None, keep: Sequence[str] = (),
                   max_categories: int = MAX_CATEGORIES, max_invalid: float = 0.3) -> DataFrame:
    """dates → parts, text → capped one-hot (0/1 ints, the intended behaviour), drop the
    remaining non-numeric columns, ±Inf → NULL, mean imputation then 0.  Categories and means
    are fitted on ``fit_df`` (default ``df``); feature outputs are double; ``keep`` columns are
    carried through unchanged."""
    fit_src = df if fit_df is None else fit_df
    state = fit_ml_prep(fit_src, keep, max_categories, max_invalid)
    out = apply_ml_prep(df, state, keep)
    fit = out if fit_df is None else apply_ml_prep(fit_df, state, keep)
    feats = [c for c in out.columns if c not in keep]
    return impute_mean(out, fit, columns=feats)


def append_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Column-wise concatenation is a projection, not a join."""
    return df.withColumns(columns)


# --------------------------------------------------------------------------- F7-F9
def split_flag(df: DataFrame, key_cols: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """adds ``is_test`` from a hash of the row key: deterministic, independent of
    partitioning, and the same rows in any engine."""
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    return df.withColumn("is_test", hash_unit(row_key(key_cols), seed) < F.lit(float(test_size)))


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """F8 fit: mean and population std (ddof 0) per column; a zero std becomes 1."""
    row = train.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                    *[F.stddev_pop(qcol(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m if m is not None else 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """F8 transform: (x − mean) / std."""
    return df.withColumns({c: (qcol(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def fit_labels(df: DataFrame, target: str, max_classes: int = MAX_ONE_HOT) -> list:
    """F9 fit: sorted class labels (few: validated ≤ 10 upstream; refused above ``max_classes``)."""
    found = df.where(qcol(target).isNotNull()).select(qcol(target)).distinct() \
              .orderBy(qcol(target)).limit(max_classes + 1).collect()
    if len(found) > max_classes:
        raise ValueError(f"{target} has more than {max_classes} classes")
    return [r[0] for r in found]


def encode_labels(df: DataFrame, target: str, labels: Sequence, out: str = "label") -> DataFrame:
    """F9 transform: class → index in the sorted label list (as double); unseen → NULL."""
    m = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
    return df.withColumn(out, m[qcol(target)])
