import datetime as dt

from qualab.operators import transform as X


def test_int_auto_and_force(spark):
    df = spark.createDataFrame([("12",), ("12d",), ("-3.7 kg",), ("4.0",), ("abc",), (None,), ("2.5",)], "s string")
    auto = [r["s"] for r in X.correct_type(df, "s", "int", "auto").collect()]
    force = [r["s"] for r in X.correct_type(df, "s", "int", "force").collect()]
    assert auto == [12, None, None, 4, None, None, None]
    assert force == [12, 12, 3, 4, None, None, 2]


def test_float_force_sign_rule(spark):
    df = spark.createDataFrame([("-3.7 kg",), ("-3 kg",), (".5",)], "s string")
    assert [r["s"] for r in X.correct_type(df, "s", "float", "force").collect()] == [-3.7, 3.0, 0.5]


def test_bool_standard_and_infer(spark):
    df = spark.createDataFrame([("False",), ("",), (None,), (" si ",), ("n",), ("maybe",)], "s string")
    std = [r["s"] for r in X.correct_type(df, "s", "bool").collect()]
    inf = [r["s"] for r in X.correct_type(df, "s", "bool", "infer").collect()]
    assert std == [True, False, False, True, True, True]
    assert inf == [False, None, None, True, False, None]


def test_date_choice_and_output(spark):
    df = spark.createDataFrame([("15/03/2020",), ("01/12/1999",), ("bad",)], "d string")
    assert X.choose_date_format(df, "d") == "%d/%m/%Y"
    assert [r["d"] for r in X.standardize_dates(df, "d", "ISO").collect()] == ["2020-03-15", "1999-12-01", None]


def test_dates_by_pattern_unchanged_when_few_valid(spark):
    df = spark.createDataFrame([("x",), ("y",), ("2020-01-01",)], "d string")
    assert X.standardize_dates_by_pattern(df, "d").schema["d"].dataType.simpleString() == "string"


def test_date_parts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6),), (None,)], "t timestamp_ntz")
    rows = X.date_parts(df, "t").collect()
    assert rows[0]["t_dia_semana"] == 5 and rows[0]["t_es_fin_de_semana"] is True
    assert rows[0]["t_nombre_dia"] == "Saturday" and rows[0]["t_semana"] == 1
    assert rows[1]["t_anio"] is None and rows[1]["t_es_fin_de_semana"] is False


def test_units_dominant_and_per_row(spark):
    df = spark.createDataFrame([("1000 g",), ("2 kg",), ("500 g",)], "w string")
    dom = [r["w_value"] for r in X.convert_units(df, "w", "kg").collect()]
    per = [r["w_value"] for r in X.convert_units(df, "w", "kg", mode="per_row").collect()]
    assert dom == [1.0, 0.002, 0.5] and per == [1.0, 2.0, 0.5]


def test_temperature_detection(spark):
    df = spark.createDataFrame([(20.0,), (30.0,)], "temp_c double")
    out = [r["temp_c"] for r in X.convert_numeric_units(df, "temp_c", "fahrenheit").collect()]
    assert out == [68.0, 86.0]


def test_corrections_report_failures(spark):
    df = spark.createDataFrame([("1",)], "a string")
    out, rep = X.apply_corrections(df, [("a", "int", "auto"), ("zz", "int", "auto"), ("a", "nope", "auto")])
    assert [r["ok"] for r in rep.collect()] == [True, False, False]
    assert out.first()["a"] == 1
