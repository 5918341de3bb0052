"""Wide ↔ long reshaping and one-row combination without joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame, ids: Sequence[str | Column], values: Mapping[str, Column],
              name_col: str = "col_name", value_col: str = "value") -> DataFrame:
    """Unpivot ``values`` (label → expression of one common type) into (ids..., name, value).

    Works for any column label (dots, spaces) because labels travel as literals.
    """
    if not values:
        raise ValueError("long_form needs at least one value column")
    pairs = [F.struct(F.lit(label).alias(name_col), expr.alias(value_col))
             for label, expr in values.items()]
    return df.select(*ids, F.inline(F.array(*pairs)))


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregate frames with disjoint columns into one row.

    Uses a union + max instead of a join, so no join (and no cross product) appears in the plan.
    """
    if len(frames) == 1:
        return frames[0]
    cols: list[str] = []
    for f in frames:
        cols.extend(c for c in f.columns if c not in cols)
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])
