"""Registry of checked queries: a Spark plan plus an independent SQL oracle.

Each entry reads the supplied tables (or fixture views derived from them) in full.  The
Spark side rounds floating results to ``DECIMALS`` places and the oracle SQL rounds the
same columns, so two correct engines agree despite different summation orders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualab.plans.fixtures import with_fixtures
from qualab.session import ensure_checkpoint_dir

DECIMALS = 6


@dataclass
class Check:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    fixtures: list[str] = field(default_factory=list)
    round_cols: list[str] = field(default_factory=list)


REGISTRY: dict[str, Check] = {}


def check(name: str, sql: str | None = None, fixtures: Sequence[str] = (),
          round_cols: Sequence[str] = ()):
    """Decorator registering ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate check {name}")
        REGISTRY[name] = Check(name, fn, sql, list(fixtures), list(round_cols))
        return fn
    return deco


def round_floats(df: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.round(c.cast("double"), decimals).alias(f.name))
        else:
            exprs.append(c)
    return df.select(*exprs)


def _load_all() -> None:
    # importing the check modules fills REGISTRY
    from qualab.plans import (checks_profile, checks_clean, checks_transform,  # noqa: F401
                              checks_validate, checks_features, checks_metrics, checks_runs,
                              checks_models, checks_trained)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def wrap(c: Check):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)   # the session's shared folder; a scratch one only if unset
            return round_floats(c.run(spark, sf_dir))
        run.__name__ = c.name
        return run
    return {n: wrap(c) for n, c in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _load_all()
    out = {}
    for n, c in REGISTRY.items():
        if c.sql is None:
            continue
        inner = c.sql.strip().rstrip(";")
        if c.round_cols:
            repl = ", ".join(f"round(CAST({col} AS DOUBLE), {DECIMALS}) AS {col}" for col in c.round_cols)
            body = f"SELECT * REPLACE ({repl}) FROM (\n{inner}\n) AS q"
        else:
            body = inner
        out[n] = with_fixtures(body, c.fixtures)
    return out


# ----------------------------------------------------------------- SQL text builders
def sql_union(branches: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(branches)


def sql_long(table: str, exprs: dict[str, str], ids: Sequence[str] = (), value: str = "value") -> str:
    """(ids..., col_name, value) branches, one per column, as a UNION ALL."""
    idl = "".join(f"{i}, " for i in ids)
    return sql_union([f"SELECT {idl}'{k}' AS col_name, {e} AS {value} FROM {table}" for k, e in exprs.items()])
