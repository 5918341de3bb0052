import math

import numpy as np
import pandas as pd

from qualab.operators import profile as P


def test_density_matches_numpy_kde(spark):
    rng = np.random.default_rng(11)
    v = np.round(rng.normal(10, 2, 300), 1)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    out = P.density(df, "v", gridsize=50).orderBy("i").toPandas()
    bw = v.std(ddof=1) * len(v) ** (-0.2)
    grid = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 50)
    exp = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert np.allclose(out["x"], grid) and np.allclose(out["density"], exp, rtol=1e-9)


def test_box_stats_whiskers(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "v": np.round(rng.normal(0, 1, 400), 2)})
    pdf.loc[:3, "v"] = [9.0, -8.0, 7.5, 10.0]
    out = {r["g"]: r for r in P.box_stats(spark.createDataFrame(pdf), "v", "g").collect()}
    for g, s in pdf.groupby("g")["v"]:
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = s[(s >= lo) & (s <= hi)]
        r = out[g]
        assert math.isclose(r["q1"], q1) and math.isclose(r["median"], s.median())
        assert r["whisker_low"] == inside.min() and r["whisker_high"] == inside.max()
        assert r["n_outliers"] == int(((s < lo) | (s > hi)).sum())


def test_crosstab_matches_pandas(spark):
    pdf = pd.DataFrame({"a": ["x", "y", "x", None, "y", "x"], "b": ["p", "q", "q", "p", None, "p"]})
    got = P.crosstab(spark.createDataFrame(pdf), "a", "b").toPandas().set_index("a").sort_index()
    exp = pd.crosstab(pdf["a"], pdf["b"])
    assert got[["p", "q"]].to_numpy().tolist() == exp.to_numpy().tolist()


def test_value_shares_sum_to_100(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    rows = P.value_shares(df, "c").collect()
    assert [r["value"] for r in rows] == ["a", "b"] and math.isclose(sum(r["pct"] for r in rows), 100.0)


def test_value_profile_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, 2.0), (2, "a", float("nan"))], "i long, s string, d double")
    pc = {r["col_name"]: r for r in P.profile_counts(P.value_profile(df)).collect()}
    assert (pc["i"]["nulls"], pc["i"]["n_distinct"]) == (0, 2)
    assert (pc["s"]["nulls"], pc["s"]["n_distinct"]) == (1, 1)
    assert (pc["d"]["nulls"], pc["d"]["n_distinct"]) == (2, 1)
