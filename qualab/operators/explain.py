"""Feature attribution.

Exact Shapley values for linear models are a projection: w_j·(x_j − mean_j).  For any fitted
model the permutation estimator is re-aimed as one Spark job: every explained row is exploded
into P permutations × (d + 1) coalition vectors (background = feature means), the model
scores all of them in one ``transform``, and consecutive coalition scores give each feature's
marginal contribution, averaged per (row, feature).  The work grows with rows·P·(d+1) and is
spread over all tasks; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualab.functions.arrow import matrix
from qualab.functions.hashing import hash_unit, row_key
from qualab.session import ensure_checkpoint_dir



def sample_rows(df: DataFrame, key_cols: Sequence[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest md5(seed|key) — a deterministic sample of the size
    that is asked for; without ``n`` every row."""
    if n is None:
        return df
    return df.withColumn("_h", hash_unit(row_key(key_cols), seed)).orderBy("_h").limit(n).drop("_h")


def linear_shap(df: DataFrame, weights: dict[str, float], background: DataFrame | None = None,
                key: str = "row_key") -> DataFrame:
    """X1 for linear models: (key, feature, value, shap = w·(x − mean)); means from
    ``background`` (default ``df``)."""
    bg = background if background is not None else df
    means = bg.agg(*[F.avg(c).alias(c) for c in weights]).first().asDict()
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                              (F.lit(w) * (F.col(c) - F.lit(means[c]))).alias("shap")) for c, w in weights.items()])
    return df.select(key, F.inline(rows))


def _score_col(out: DataFrame) -> Column:
    if "probability" in out.columns:
        arr = vector_to_array("probability")
        return F.when(F.size(arr) == 2, arr[1]).otherwise(F.col("prediction").cast("double"))
    return F.col("prediction").cast("double")


def _shares_by_trees(model, x: DataFrame, mean: list[float], permutations: int, seed: int) -> DataFrame:
    """(_k, _j, shap): the shares of :func:`permutation_shap` for a model whose score is the mean over its trees' leaves.

    The coalition vectors of a row meet few leaves of a tree, so all of a row's permutations are followed down a tree at
    once (:func:`qualab.operators.trees.permutation_shares`).  The tasks hold one part of a large model at a time."""
    from qualab.operators.trees import dealt, permutation_shares

    d, context, which = len(mean), x.sparkSession.sparkContext, model.outputs - 1
    until = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    hashes = F.flatten(F.transform(until(permutations), lambda p: F.transform(until(d), lambda j: F.xxhash64(F.lit(seed), F.col("_k"), p, j))))
    rows = dealt(x.select("_k", "_x", hashes.alias("_h")))
    large = model.nodes() > model.broadcast_nodes
    if large:
        ensure_checkpoint_dir(x.sparkSession)
        rows = rows.checkpoint()
    kind, per = rows.schema["_k"].dataType.simpleString(), None
    for ensemble in model.parts():
        held = context.broadcast((ensemble, np.array(mean)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ensemble, mean = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    order = np.argsort(matrix(part.column("_h")).reshape(-1, permutations, d), axis=2, kind="stable")
                    phi = permutation_shares(ensemble, matrix(part.column("_x")), mean, np.argsort(order, axis=2), which)
                    ends = pa.array(np.arange(len(phi) + 1, dtype=np.int32) * d)
                    yield pa.RecordBatch.from_arrays([part.column("_k"), pa.ListArray.from_arrays(ends, pa.array(phi.reshape(-1)))], names=["_k", "_phi"])

        one = rows.mapInArrow(run, f"_k {kind}, _phi array<double>")
        if large:
            one = one.checkpoint()
            held.destroy()
        per = one if per is None else per.unionByName(one)
    return per.select("_k", F.posexplode("_phi").alias("_j", "_d")).groupBy("_k", "_j").agg(F.sum("_d").alias("shap"))


def permutation_shap(model, df: DataFrame, feature_names: Sequence[str], background: DataFrame | None = None,
                     permutations: int = 32, key: str = "row_key", features_col: str = "features",
                     seed: int = 42) -> DataFrame:
    """X1 for any model with a ``transform``: (key, feature, value, shap).

    The background is the vector of feature means.  For each row and permutation π the
    coalition vectors z_0 … z_d switch features to the row's values in π order; the shap of
    feature π[t] is f(z_{t+1}) − f(z_t), averaged over permutations (exact for linear models).  For
    forests without a depth limit the same scores come from the leaves that the vectors reach."""
    d = len(feature_names)
    bg = background if background is not None else df
    mean_arr = bg.select(vector_to_array(features_col).alias("x")) \
                 .select(*[F.col("x")[j].alias(f"m{j}") for j in range(d)]).agg(*[F.avg(f"m{j}").alias(f"m{j}") for j in range(d)]).first()
    mu = F.array(*[F.lit(float(mean_arr[f"m{j}"])) for j in range(d)])
    x = df.select(F.col(key).alias("_k"), vector_to_array(features_col).alias("_x"))
    perm = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_p"))
    # permutation: feature indices sorted by a hash of (seed, row, p, j)
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                                 lambda j: F.struct(F.xxhash64(F.lit(seed), F.col("_k"), F.col("_p"), j).alias("h"),
                                                    j.alias("j")))),
        lambda s: s["j"])
    perm = perm.withColumn("_ord", order)
    coal = perm.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("_t"))
    # rank of each feature in the permutation: feature j is switched on when its rank < t
    rank = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.array_position(F.col("_ord"), j) - 1)
    z = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                    lambda j: F.when(rank[j] < F.col("_t"), F.col("_x")[j]).otherwise(mu[j]))
    coal = coal.select("_k", "_p", "_t", "_ord", array_to_vector(z).alias(features_col))

    def shares(scored: DataFrame, score: Column) -> DataFrame:
        scored = scored.select("_k", "_p", "_t", "_ord", score.alias("_f"))
        # f(z_t) counts for the feature that step t switched on, and against the one that comes next
        t, f = F.col("_t"), F.col("_f")
        on = F.when(t > 0, F.struct(F.element_at("_ord", F.when(t > 0, t)).alias("_j"), f.alias("_d")))
        off = F.when(t < d, F.struct(F.element_at("_ord", F.when(t < d, t + 1)).alias("_j"), (-f).alias("_d")))
        deltas = scored.select("_k", F.inline(F.array_compact(F.array(on, off))))
        return deltas.groupBy("_k", "_j").agg((F.sum("_d") / permutations).alias("shap"))

    if hasattr(model, "parts") and model.outputs <= 2 and d <= 64:
        per = _shares_by_trees(model, x, [float(mean_arr[f"m{j}"]) for j in range(d)], permutations, seed)
    elif hasattr(model, "parts") and model.outputs <= 2 and model.nodes() > model.broadcast_nodes:
        # the score is a sum over the model's trees, and so are the shares: the tasks hold one part of it at a time
        # instead of shuffling every coalition to every tree
        ensure_checkpoint_dir(df.sparkSession)
        per = None
        for ensemble in model.parts():
            one = shares(model.outputs_of(coal, ensemble), F.get("_out", F.lit(model.outputs - 1))).checkpoint()
            per = one if per is None else per.unionByName(one)
        per = per.groupBy("_k", "_j").agg(F.sum("shap").alias("shap"))
    else:
        scored = model.transform(coal)
        per = shares(scored, _score_col(scored))
    names = F.array(*[F.lit(n) for n in feature_names])
    vals = x.select("_k", F.posexplode("_x").alias("_j", "value"))
    return per.join(vals, ["_k", "_j"]).select(F.col("_k").alias(key), F.element_at(names, F.col("_j") + 1).alias("feature"),
                                               "value", "shap")


def explain(model, df: DataFrame, feature_names: Sequence[str], background: DataFrame, background_rows: int = 100,
            permutations: int = 32, key: str = "row_key", features_col: str = "features", seed: int = 42) -> DataFrame:
    """X1, by what the model is: exact values against a background table for trees, forests and boosted trees
    (:func:`qualab.operators.trees.tree_shap`), the closed form for linear models, permutations for any other.
    (key, feature, value, shap), for trees with ``base``."""
    from qualab.operators import trees

    kind = type(model).__name__
    if hasattr(model, "ensemble") or any(t in kind for t in ("DecisionTree", "RandomForest", "GBT")):
        return trees.tree_shap(model, df, feature_names, background, background_rows, None, key, features_col, seed)
    if kind == "LinearRegressionModel":
        columns = lambda t: t.select(key, *[vector_to_array(features_col)[j].alias(n) for j, n in enumerate(feature_names)])
        return linear_shap(columns(df), dict(zip(feature_names, map(float, model.coefficients))), columns(background), key)
    return permutation_shap(model, df, feature_names, background, permutations, key, features_col, seed)


def importance(shap: DataFrame, top: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean |shap| per feature, descending (ties: feature name), top ``top``."""
    agg = shap.groupBy(*keys, "feature").agg(F.avg(F.abs("shap")).alias("importance"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(F.col("importance").desc(), "feature")
    out = agg.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top) if top else out


def beeswarm(shap: DataFrame, key: str = "row_key") -> DataFrame:
    """(key, feature, shap, feature value, value rank within the feature in [0, 1])."""
    # per-feature range from an aggregate (one row per feature) joined back, not a window
    rng = shap.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    return shap.join(F.broadcast(rng), "feature").select(
        key, "feature", "shap", "value",
        F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(0.5)).alias("value_scaled"))
