import pandas as pd
from pyspark.sql import functions as F

from qualab.operators import dedup as D

ROWS = [(1, "x", 10.0, 1), (1, "x", None, 2), (2, "y", 5.0, 3), (1, "x", 7.0, 4), (None, "z", 1.0, 5),
        (None, "z", 2.0, 6)]
SCHEMA = "k int, g string, v double, o int"


def _pdf():
    return pd.DataFrame(ROWS, columns=["k", "g", "v", "o"])


def test_keep_first_last_none(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    first = sorted(r["o"] for r in D.drop_duplicates(df, ["k", "g"], "first", order_by=["o"]).collect())
    last = sorted(r["o"] for r in D.drop_duplicates(df, ["k", "g"], "last", order_by=["o"]).collect())
    none = sorted(r["o"] for r in D.drop_duplicates(df, ["k", "g"], "none").collect())
    p = _pdf().sort_values("o")
    assert first == sorted(p.drop_duplicates(["k", "g"], keep="first")["o"])
    assert last == sorted(p.drop_duplicates(["k", "g"], keep="last")["o"])
    assert none == sorted(p.drop_duplicates(["k", "g"], keep=False)["o"])


def test_duplicate_rows_after_first(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(r["o"] for r in D.duplicate_rows(df, ["k", "g"], order_by=["o"]).collect())
    assert got == sorted(_pdf().sort_values("o").loc[lambda d: d.duplicated(["k", "g"]), "o"])


def test_merge_first_non_null(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = {(r["k"], r["g"]): r for r in D.merge_duplicates(df, ["k", "g"], {"v": "first", "o": "count"},
                                                            order_by=["o"]).collect()}
    assert out[(1, "x")]["v"] == 10.0 and out[(1, "x")]["o"] == 3
    assert out[(None, "z")]["v"] == 1.0                # NULL keys are a group (drop_null_keys=False)
    assert (None, "z") not in {(r["k"], r["g"]) for r in
                               D.merge_duplicates(df, ["k", "g"], order_by=["o"], drop_null_keys=True).collect()}


def test_merge_median_mode(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 3.0, "b"), (1, 10.0, "b"), (2, 4.0, None)], "k int, v double, s string")
    out = {r["k"]: r for r in D.merge_duplicates(df, ["k"], {"v": "median", "s": "mode"}).collect()}
    assert out[1]["v"] == 3.0 and out[1]["s"] == "b" and out[2]["s"] is None


def test_reduction_stats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = D.reduction_stats(df, ["k", "g"]).first()
    assert (r["before"], r["after"], r["removed"]) == (6, 3, 3)
    assert D.reduction_stats(df.limit(0), ["k"]).first()["removed_pct"] == 0.0


def test_fingerprints_tell_rows_apart_as_a_group_by_does(spark):
    from pyspark.sql import functions as F
    from qualab.functions.hashing import group_sizes
    from qualab.operators import profile as P

    nan = float("nan")
    rows = [(None, "a", 0.0, [1]), ("a", None, -0.0, [1]), ("a", None, 0.0, [1]), (None, None, nan, None), (None, None, nan, None),
            (None, None, None, None), ("", "a", 0.0, [1]), (None, "a", 0.0, [1, None]), ("null", "a", 0.0, [1])] * 2 + [("x", "y", 1.5, [])]
    df = spark.createDataFrame(rows, "a string, b string, c double, d array<int>")
    want = sorted(r["count"] for r in df.groupBy("a", "b", "c", "d").count().collect())
    assert sorted(r["_n"] for r in group_sizes(df, df.columns).collect()) == want
    assert P.duplicate_count(df).first()[0] == sum(n - 1 for n in want)
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("text"))
    plan = P.duplicate_count(wide)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_groupingexpression" in plan and "hashpartitioning(id" not in plan
