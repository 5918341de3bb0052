from qualab.operators import validate as V


def test_target_rules(spark):
    df = spark.createDataFrame([(float(i % 3), "a" if i % 2 else None, 1.0) for i in range(30)],
                               "y double, s string, c double")
    assert V.validate_target(df, "nope", "regresion").first()["rule"] == "missing_column"
    assert V.validate_target(df, "c", "regresion").first()["rule"] == "constant"
    assert V.validate_target(df, "s", "clasificacion").first()["rule"] == "too_many_nulls"
    assert V.validate_target(df, "s", "regresion").first()["rule"] == "too_many_nulls"
    assert V.validate_target(df, "y", "clasificacion").first()["valid"] is True


def test_rare_class(spark):
    df = spark.createDataFrame([(0,)] * 200 + [(1,)], "y int")
    assert V.validate_target(df, "y", "clasificacion").first()["rule"] == "rare_class"


def test_problem_type(spark):
    df = spark.createDataFrame([(float(i), i % 3) for i in range(100)], "r double, c int")
    assert V.problem_type(df, "r").first()["problem_type"] == "regresion"
    assert V.problem_type(df, "c").first()["problem_type"] == "clasificacion"


def test_possible_date(spark):
    df = spark.createDataFrame([("2020-01-05",), ("5 Mar 2021",), ("March 5, 2021",), ("hello",), ("20200105",)],
                               "s string")
    got = [r[0] for r in df.select(V.possible_date(df["s"])).collect()]
    assert got == [True, True, True, False, False]
