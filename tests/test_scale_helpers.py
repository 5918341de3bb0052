"""Running totals, exact k-NN, penalised models, catalog and Q-Q points against plain numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from qualab.functions.ranks import running_totals, slice_of, split_points
from qualab.operators import crossval as C
from qualab.operators import dedup as D
from qualab.operators import metrics as M
from qualab.operators import models as MO
from qualab.operators import models_custom as MC
from qualab.sources.store import Store


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield
    spark.conf.set("spark.sql.exchange.reuse", old)


def test_stratified_folds_of_many_rows(spark, reuse):
    df = spark.range(0, 200_000, 1, 8).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 3).alias("y"))
    folds = C.assign_folds(df, ["row_key"], 5, label="y")
    counts = folds.groupBy("y", "fold").count()
    spread = counts.groupBy("y").agg((F.max("count") - F.min("count")).alias("d"), F.sum("count").alias("n")).collect()
    assert all(r["d"] <= 1 for r in spread) and sum(r["n"] for r in spread) == 200_000
    twice = folds.withColumnRenamed("fold", "f1").join(C.assign_folds(df, ["row_key"], 5, label="y"), "row_key")
    assert twice.where("f1 <> fold").count() == 0


def test_auc_equals_the_pair_count(spark):
    df = spark.range(0, 200_000, 1, 8).select(
        F.lit("r").alias("run_id"), F.lit("m").alias("model"), F.pmod(F.hash("id"), F.lit(2)).cast("double").alias("label"),
        (F.pmod(F.xxhash64("id"), F.lit(50_000)) / 50_000 + F.pmod(F.hash("id"), F.lit(2)) * 0.3).alias("probability"))
    rows = df.select("label", "probability").toPandas()
    order = rows["probability"].rank().to_numpy()
    pos = rows["label"].to_numpy() == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert abs(M.roc_auc(df).first()["auc"] - auc) < 1e-12


def test_running_totals_on_awkward_values(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=300), rng.normal(size=300) * 1e12, 1e9 + rng.normal(size=300), -rng.lognormal(0, 9, 300), [0.0]])
    df = spark.createDataFrame([(("a", None)[i % 2], float(v), 1 + i % 3) for i, v in enumerate(values)], "k string, v double, w long")
    for key, part in df.toPandas().groupby("k", dropna=False):
        want = part.sort_values("v")["w"].cumsum().tolist()
        got = running_totals(df, ["k"], F.col("v"), ["w"]).where(F.col("k").eqNullSafe(F.lit(key if isinstance(key, str) else None)))
        got = got.orderBy("v").toPandas()
        assert got["cum_w"].tolist() == want and set(got["tot_w"]) == {want[-1]}


def test_penalised_regressions_minimise_their_objectives(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = 50 * x[:, 0] - 20 * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame([([float(a) for a in r], float(b)) for r, b in zip(x, y)], "x array<double>, label double") \
              .select(array_to_vector("x").alias("features"), "label")
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)

    def descent(l1, l2):
        w = np.zeros(3)
        for _ in range(5000):
            for j in range(3):
                rest = yc - xc @ w + xc[:, j] * w[j]
                rho = xc[:, j] @ rest / n
                w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2)
        return w

    for name, l1, l2 in (("Ridge", 0, 1 / n), ("Lasso", 1, 0), ("ElasticNet", 0.5, 0.5)):
        got = MO.make_estimator(name, "regresion", n).fit(df).coefficients.toArray()
        assert np.allclose(got, descent(l1, l2), atol=1e-3), name


def test_knn_ties_go_by_key(spark):
    train = [(f"{i:03d}", [0.0, 0.0], float(i < 5)) for i in range(60)] + [(f"z{i}", [3.0, float(i)], 0.0) for i in range(40)]
    test = [("q", [0.0, 0.0], 0.0), ("q", [3.0, 1.2], 0.0), ("p", [0.0, 0.0], 1.0)]
    make = lambda rows: spark.createDataFrame(rows, "row_key string, x array<double>, label double") \
        .select("row_key", array_to_vector("x").alias("features"), "label")
    model = MC.KNeighbors(k=5, block_rows=16).fit(make(train))
    got = sorted((r["row_key"], tuple(r["features"].toArray()), r["prediction"]) for r in model.transform(make(test)).collect())
    assert got == [("p", (0.0, 0.0), 1.0), ("q", (0.0, 0.0), 1.0), ("q", (3.0, 1.2), 0.0)]


def test_deleted_datasets_stay_deleted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    kept = store.save_dataset(spark.range(3), "kept")
    for i in range(4):
        assert store.delete_dataset(store.save_dataset(spark.range(2), f"d{i}"))
    assert [r["id"] for r in store.datasets().collect()] == [kept]


def test_first_needs_an_order(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    for call in (lambda: D.drop_duplicates(df, ["k"]), lambda: D.merge_duplicates(df, ["k"])):
        with pytest.raises(ValueError):
            call()


def test_qq_points_rank_every_row(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([("r", "m", float(x)) for x in v], "run_id string, model string, residual double")
    got = M.qq_points(df).orderBy("rank").toPandas()
    n = len(v)
    p = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    p[-1], p[0] = 0.5 ** (1 / n), 1 - 0.5 ** (1 / n)
    t = np.array([NormalDist().inv_cdf(x) for x in p])
    assert np.allclose(got["sample"], np.sort(v)) and np.allclose(got["theoretical"], t, atol=1e-6)
    slope, intercept = np.polyfit(t, np.sort(v), 1)
    assert abs(got["slope"][0] - slope) < 1e-6 and abs(got["intercept"][0] - intercept) < 1e-6


def test_slice_variances_keep_their_digits_far_from_zero(spark):
    rng = np.random.default_rng(3)
    e = np.sort(rng.normal(size=1000) + 1e8)
    df = spark.createDataFrame([("r", "m", float(x), 0.0) for x in e], "run_id string, model string, label double, prediction double")
    parts = [e[i * 200 : (i + 1) * 200].var() for i in range(5)]
    assert abs(M.residual_diagnosis(df).first()["variance_ratio"] / (max(parts) / min(parts)) - 1) < 1e-6


def test_slices_stay_even_whatever_the_values(spark):
    """A cluster far from zero with one wild value, several magnitudes, two clusters: no slice above 2 / S of the rows."""
    n, slices = 60_000, 64
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    df = spark.range(0, n, 1, 8).select(F.inline(F.array(
        F.struct(F.lit("cluster").alias("k"), F.when(F.col("id") == 7, 1e15).otherwise(1.7e9 + unit * 1e6).alias("v")),
        F.struct(F.lit("magnitudes").alias("k"), F.exp(unit * 400 - 200).alias("v")),
        F.struct(F.lit("two").alias("k"), F.when(F.col("id") % 2 == 0, 1e9 + unit).otherwise(-5e3 - unit * 1e-3).alias("v")),
        F.struct(F.lit(None).cast("string").alias("k"), F.col("id").cast("double").alias("v")))))
    df = df.withColumn("_g", F.struct("k"))
    points = split_points(df, "_g", "v", slices)
    sizes = df.join(points, "_g").groupBy("k", slice_of(F.col("points"), F.col("v"), slices).alias("s")).count().toPandas()
    assert len(sizes) >= 4 * (slices - 2) and sizes["count"].max() <= 2 * n / slices
    other = split_points(df.repartition(5, "v"), "_g", "v", slices)        # the same points from any partitioning
    assert sorted(map(str, points.collect())) == sorted(map(str, other.collect()))
    ranks = running_totals(df.withColumn("w", F.lit(1)), ["k"], F.col("v"), ["w"], then=[F.col("k")])
    ends = ranks.groupBy("k").agg(F.min("cum_w"), F.max("cum_w"), F.count("*"), F.max("tot_w")).collect()
    assert all(tuple(r)[1:] == (1, n, n, n) for r in ends) and len(ends) == 4


@pytest.mark.parametrize("points,x,want", [([], 3.0, 0), ([1.0], 0.5, 0), ([1.0], 1.0, 1), ([1.0, 2.0, 4.0], 3.9, 2),
                                           ([float(i) for i in range(63)], 62.5, 63), ([1.0, 2.0], None, 0)])
def test_slice_of_is_a_binary_search(spark, points, x, want):
    df = spark.createDataFrame([(points, x)], "p array<double>, x double")
    assert df.select(slice_of(F.col("p"), F.col("x"), 64)).first()[0] == want


def knn_brute(train, test, k):
    """{(key, x): [(distance, key of neighbour)]}"""
    out = {}
    for qk, q, _ in test:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(q)) ** 2).sum())), key) for key, x, _ in train)
        out[qk, tuple(q)] = d[:k]
    return out


def knn_rows(spark, rows):
    return spark.createDataFrame(rows, "row_key string, x array<double>, label double") \
                .select("row_key", array_to_vector("x").alias("features"), "label")


@pytest.mark.parametrize("kind", ["clustered", "one_hot", "line"])
def test_knn_equals_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "clustered":
        centers = rng.normal(size=(12, 8)) * 10
        draw = lambda n: centers[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * 0.3
    elif kind == "uniform":
        draw = lambda n: rng.random((n, 6))
    elif kind == "one_hot":
        draw = lambda n: np.eye(5)[rng.integers(0, 5, n)]
    else:
        draw = lambda n: np.round(rng.lognormal(0, 2, (n, 1)), 1) + 1e6
    train = [(f"t{i:04d}", [float(v) for v in x], float(i % 3)) for i, x in enumerate(draw(700))]
    test = [(f"q{i}", [float(v) for v in x], float(i % 3)) for i, x in enumerate(draw(120))] + [("q0", train[5][1], 0.0)]
    model = MC.KNeighbors(k=5, block_rows=64).fit(knn_rows(spark, train))
    want = knn_brute(train, test, 5)
    asked = knn_rows(spark, test)
    ids = asked.select("row_key", "features", *MC.KNeighborsModel._query_id(asked))
    got = ids.join(model.nearest(asked), ["q1", "q2"]).collect()
    assert len(got) == len(test)
    for r in got:
        assert [n["nb_key"] for n in r["nb"]] == [key for _, key in want[r["row_key"], tuple(r["features"].toArray())]], r["row_key"]


def test_knn_visits_few_cells_of_clustered_vectors(spark):
    centers = spark.createDataFrame([(c, [float(v) for v in np.random.default_rng(c).normal(size=16) * 5]) for c in range(30)], "c int, m array<double>")
    noise = F.array(*[F.randn(i) * 0.2 for i in range(16)])
    many = spark.range(3000).withColumn("c", (F.col("id") % 30).cast("int")).join(centers, "c").select(
        F.col("id").cast("string").alias("row_key"), array_to_vector(F.zip_with("m", noise, lambda a, b: a + b)).alias("features"),
        (F.col("c") % 2).cast("double").alias("label")).cache()
    for data, share in ((many, 0.06),):
        model = MC.KNeighbors(k=5, block_rows=64).fit(data)
        queries = model._with_cell(model._queries(data), "qx").drop("r")
        home = model._search(queries.withColumn("radius", F.lit(float("inf"))))
        kth = model._best(home).select("q1", "q2", F.get("nb", F.lit(4))["dist"].alias("radius"))
        visits = model.routes(queries.join(kth, ["q1", "q2"], "left")).count()
        assert visits <= share * len(model.pivots) * queries.count()


def test_knn_keeps_cells_across_save_and_load(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(f"{i}", [float(v) for v in rng.normal(size=3)], float(i % 2)) for i in range(200)]
    model = MC.KNeighbors(k=3, block_rows=32).fit(knn_rows(spark, rows))
    model.write().overwrite().save(f"{tmp_path}/m")
    back = MC.KNeighborsModel.load(f"{tmp_path}/m")
    a, b = (sorted((r["row_key"], r["prediction"]) for r in m.transform(knn_rows(spark, rows[:40])).collect()) for m in (model, back))
    assert a == b and len(a) == 40


def test_knn_without_training_rows_predicts_null(spark):
    model = MC.KNeighbors(k=3).fit(knn_rows(spark, []))
    assert [r["prediction"] for r in model.transform(knn_rows(spark, [("a", [1.0], 0.0)])).collect()] == [None]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_huge_group_is_not_joined_in_one_task(spark):
    df = spark.range(20_000).select(F.lit("g").alias("k"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"), F.lit(1).alias("w"))
    ranks = running_totals(df, ["k"], F.col("v"), ["w"], slices=16)
    plan = plan_of(ranks)
    assert "_part" in plan and "SortAggregate" not in plan
    assert ranks.where(F.col("cum_w") != F.col("v") + 1).count() == 0 and ranks.count() == 20_000


def test_the_fit_line_meets_the_points_in_parts(spark):
    df = spark.range(3_000).select(F.lit("r").alias("run_id"), F.lit("m").alias("model"), (F.col("id") % 500).cast("double").alias("residual"))
    points = M.qq_points(df)
    assert plan_of(points).count("_part") > 1 and points.count() == 3_000
    assert points.select("slope", "intercept", "r").distinct().count() == 1


def test_routes_of_few_queries_at_a_time():
    import pyarrow as pa

    class Near:  # stands for a table: hands out the function that its tasks run
        sparkSession = sparkContext = property(lambda self: self)
        broadcast = staticmethod(lambda value: type("Held", (), {"value": value}))
        mapInArrow = staticmethod(lambda run, schema: run)

    rng = np.random.default_rng(3)
    cells = np.tile([10.0, 0.0, 9.0], (50, 1))
    run = MC.KNeighborsModel(None, 1, "regresion", 4096, rng.normal(size=(50, 3)), cells).routes(Near())
    n = 3_000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(list(rng.normal(size=(n, 3)))), pa.array(np.full(n, 50.0)),
         pa.array(rng.integers(0, 50, n).astype(np.int32))], names=["q1", "q2", "qx", "radius", "cell"])
    out = list(run([batch.slice(0, 0), batch]))
    assert sum(b.num_rows for b in out) == n * 49          # every query goes to every other cell
    assert max(b.num_rows for b in out) <= MC.ROUTED * 49
