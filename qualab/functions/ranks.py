"""Distributed running totals, ranks and exact quantiles.

Spark has no distributed prefix sum: a window without ``partitionBy`` puts every row in one
task.  The helpers here use a two-phase scheme instead:

1. each group is cut into slices at split points taken from its own values.  The points come
   from a sketch that any evaluation of the plan fills alike: values fall into slots by hash,
   each slot keeps the value of the least hash (an aggregate, combined map-side), and every
   n-th of the kept values, sorted, is a split point.  Slices hold about equally many rows
   whatever the distribution (outliers, clusters far from zero, several magnitudes);
2. a window within (group, slice) computes the local running total; slice totals are an
   aggregate on the same keys, without a further exchange;
3. the small table of slice totals gives each slice its offset.

The work per task is bounded by the slice size, so one huge group is spread over all tasks.
Callers pre-aggregate to distinct order values first, so a hot value is a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LEAST_SLICES = 64      # slices of a group, at least; else two per shuffle partition
MOST_SLICES = 1 << 14
SLOTS_PER_SLICE = 32   # sketch size: the largest slice stays below twice the mean
SPREAD = 64            # parts of a group that meet a copy of the group's own row each
FEW_PER_SLICE = 8      # a group of fewer kept values for each slice is one slice


def default_slices(spark: SparkSession) -> int:
    """Two slices per shuffle partition, between fixed bounds."""
    return min(MOST_SLICES, max(LEAST_SLICES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _sketch(df: DataFrame, group: str, x: str, slices: int) -> DataFrame:
    """(group, _all): the kept values of each group, sorted."""
    slots = slices * SLOTS_PER_SLICE
    seen = df.where(F.col(x).isNotNull())
    # two numbers a slot: this aggregate hashes, while the least of a struct would sort all rows of a task first
    kept = seen.groupBy(group, F.pmod(F.xxhash64(x), F.lit(slots)).alias("_slot")).agg(
        F.min_by(x, F.xxhash64(F.lit(slots), F.col(x))).alias("_kept"))
    return kept.groupBy(group).agg(F.sort_array(F.collect_list("_kept")).alias("_all"))


def split_points(df: DataFrame, group: str, x: str, slices: int) -> DataFrame:
    """(group, points): at most ``slices - 1`` ascending values of ``x`` that cut each group into even parts.

    A function of the set of values alone: neither partitioning nor the order of merging matters."""
    return _points(_sketch(df, group, x, slices), group, slices)


def _points(some: DataFrame, group: str, slices: int) -> DataFrame:
    nth = F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / slices).cast("int")))
    return some.select(group, F.array_distinct(nth).alias("points"))


def slice_of(points: Column, x: Column, slices: int) -> Column:
    """How many of the ascending ``points`` are at most ``x``: binary search, 0 for a NULL."""
    steps = F.array(*[F.lit(1 << k) for k in range((slices - 1).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) <= x, at + step).otherwise(at))


def spread_join(df: DataFrame, of_group: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """``df`` left-joined with ``of_group`` (one row a group): the rows of a group go to ``SPREAD`` parts by the hash
    of ``by``, each with a copy of the group's row, so that a huge group is not joined and sorted in one task."""
    copies = of_group.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return df.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(copies, [*keys, "_part"], "left").drop("_part")


def running_totals(df: DataFrame, keys: Sequence[str], by: Column, weights: Sequence[str],
                   then: Sequence[Column] = (), slices: int | None = None) -> DataFrame:
    """Add ``cum_<w>`` (inclusive running sum within ``keys``) and ``tot_<w>``.

    The order is by the number ``by``, ascending, then by the columns ``then``.  Rows should be
    unique in this order; what ties get is arbitrary but consistent.  NULL keys are groups.
    """
    slices = slices or default_slices(df.sparkSession)
    # one struct as group: NULL fields compare as equal, so windows and joins share one partitioning
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    tagged = df.withColumn("_x", by.cast("double") + F.lit(0.0)).withColumn("_g", group)
    if keys:
        # small groups need no cut; the copies of a large one's points take less room than its rows
        some = _sketch(tagged.select("_g", "_x"), "_g", "_x", slices).where(F.size("_all") > FEW_PER_SLICE * slices)
        part = spread_join(tagged, _points(some, "_g", slices), ["_g"], F.col("_x"))
    else:
        part = tagged.join(F.broadcast(split_points(tagged.select("_g", "_x"), "_g", "_x", slices)), "_g", "left")
    part = part.withColumn("_s", slice_of(F.col("points"), F.col("_x"), slices)).drop("points")
    within = Window.partitionBy("_g", "_s").orderBy(F.col("_x").asc(), *then)
    local = part.select("*", *[F.sum(w).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_loc_{w}")
                               for w in weights])
    of_group = Window.partitionBy("_g")
    before = of_group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy("_g", "_s").agg(*[F.sum(w).alias(f"_blk_{w}") for w in weights]).select(
        "_g", "_s",
        *[F.coalesce(F.sum(f"_blk_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weights],
        *[F.sum(f"_blk_{w}").over(of_group).alias(f"tot_{w}") for w in weights])
    return local.join(offsets, ["_g", "_s"]).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"_off_{w}") + F.col(f"_loc_{w}")).alias(f"cum_{w}") for w in weights],
        *[F.col(f"tot_{w}") for w in weights])


def value_counts(long_df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, w): multiplicity of every non-null value per group (map-side combined)."""
    return (long_df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("w")))


def exact_quantiles(long_df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    slices: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas ``quantile`` / SQL ``quantile_cont``).

    Returns one row per (keys, p): keys..., ``p``, ``q``, ``n`` (non-null count).
    """
    return exact_quantiles_from_counts(value_counts(long_df, keys, value), keys, value, probs, slices)


def exact_quantiles_from_counts(counts: DataFrame, keys: Sequence[str], value: str,
                                probs: Sequence[float], slices: int | None = None) -> DataFrame:
    """As :func:`exact_quantiles` over a pre-aggregated (keys, value, w) table."""
    keys = list(keys)
    ranked = running_totals(counts, keys, F.col(value), ["w"], slices=slices)
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    pos = F.col("p") * (F.col("tot_w") - 1)
    first_rank = F.col("cum_w") - F.col("w")          # 0-based rank of the first copy
    last_rank = F.col("cum_w") - 1
    lo = F.floor(pos)
    hi = F.ceil(pos)
    # only the rows around a wanted rank leave the scan of the ranks
    near = F.filter(probs_arr, lambda p: (F.ceil(p * (F.col("tot_w") - 1)) >= first_rank) & (F.floor(p * (F.col("tot_w") - 1)) <= last_rank))
    rows = (ranked.select(*keys, value, "w", "cum_w", "tot_w", F.explode(near).alias("p"))
            .select(*keys, value, "p", "tot_w", pos.alias("pos"),
                    ((lo >= first_rank) & (lo <= last_rank)).alias("has_lo"),
                    ((hi >= first_rank) & (hi <= last_rank)).alias("has_hi")))
    agg = rows.groupBy(*keys, "p").agg(
        F.min(F.when(F.col("has_lo"), F.col(value))).alias("v_lo"),
        F.min(F.when(F.col("has_hi"), F.col(value))).alias("v_hi"),
        F.first("pos").alias("pos"),
        F.first("tot_w").alias("n"),
    )
    frac = F.col("pos") - F.floor(F.col("pos"))
    return agg.select(*keys, "p",
                      (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * frac).alias("q"),
                      F.col("n"))

