import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions.cells import as_text
from tidemark.operators import transforms as X
from tidemark.plans.runner import apply_plan, step


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [(1, "R$ 10", 1.5, "a"), (2, None, float("nan"), "b"), (None, "R$ 30", 0.25, "c")],
        "n int, `my.price` string, v double, A string",
    )


def column(df, name):
    return [r[0] for r in df.select(F.col(f"`{name}`")).collect()]


def test_rename(table):
    assert X.rename_column(table, "my.price", "price").columns == ["n", "price", "v", "A"]
    assert X.rename_column(table, "A", "a").columns[-1] == "a"  # only the case changes
    with pytest.raises(ValueError, match="not in the table"):
        X.rename_column(table, "a", "b")
    with pytest.raises(ValueError, match="already exists"):
        X.rename_column(table, "n", "a")
    with pytest.raises(ValueError, match="already exists"):
        X.rename_column(table, "n", "n")
    with pytest.raises(ValueError, match="frozen"):
        X.rename_column(table, "n", "m", frozen={"n"})


def test_drop(table):
    assert X.drop_column(table, "my.price").columns == ["n", "v", "A"]
    with pytest.raises(ValueError):
        X.drop_column(table, "nope")
    with pytest.raises(ValueError, match="frozen"):
        X.drop_column(table, "n", frozen={"n"})


def test_replace_is_literal_and_keeps_missing(table):
    assert column(X.replace_substring(table, "my.price", "R$ ", ""), "my.price") == ["10", None, "30"]
    assert column(X.replace_substring(table, "v", ".", ","), "v") == ["1,5", None, "0,25"]
    assert column(X.replace_substring(table, "n", "1", "one"), "n") == ["one", "2", None]
    with pytest.raises(ValueError, match="empty"):
        X.replace_substring(table, "A", "", "x")


@pytest.mark.parametrize(
    "value", [0.0, 1.0, -2.5, 1e7, 123456789.125, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 1e-5, 1.25e-7, float("inf"), -float("inf")]
)
def test_text_of_floats_is_pythons(spark, value):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(as_text(F.col("v"), df.schema["v"].dataType)).first()[0] == repr(value)


def test_fill_and_flag(table):
    out = X.fill_col_na(table, "v", 9)
    assert out.columns[-1] == "imputed_v"
    assert column(out, "v") == [1.5, 9.0, 0.25]
    assert column(out, "imputed_v") == [False, True, False]
    assert column(X.fill_col_na(table, "n", 2.5), "n") == [1.0, 2.0, 2.5]
    assert column(X.fill_col_na(table, "my.price", "-"), "my.price") == ["R$ 10", "-", "R$ 30"]


def test_second_fill_keeps_marks(table):
    once = X.fill_col_na(table, "v", 1.5)
    again = X.fill_col_na(
        once.withColumn("v", F.nullif("v", F.lit(0.25))), "v", 0.0, frozen={"imputed_v"}
    )
    assert column(again, "imputed_v") == [False, True, True]
    with pytest.raises(ValueError, match="already exists"):
        X.fill_col_na(once, "v", 0.0)


@pytest.mark.parametrize("name, value", [("v", "x"), ("n", "1"), ("n", True), ("A", 1), ("v", None)])
def test_fill_checks_the_type(table, name, value):
    with pytest.raises(ValueError, match="cannot fill"):
        X.fill_col_na(table, name, value)


def test_fill_dates(spark):
    df = spark.sql("select cast(null as timestamp_ntz) as t")
    assert X.fill_col_na(df, "t", "2024-05-06").first()["t"] == dt.datetime(2024, 5, 6)


def converted(spark, texts, step):
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    return column(step(df, "t"), "t")


def test_to_datetime(spark):
    texts = ["09/09/2021", " 16/9/2021 ", "31/02/2021", "2021-03-28 02:30:00", "2021-03-04T05:06:07", "x", None, ""]
    assert converted(spark, texts, X.convert_column_to_datetime) == [
        dt.datetime(2021, 9, 9), dt.datetime(2021, 9, 16), None, dt.datetime(2021, 3, 28, 2, 30),
        dt.datetime(2021, 3, 4, 5, 6, 7), None, None, None,
    ]


def test_to_datetime_is_free_of_the_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 was skipped there
    try:
        assert converted(spark, ["28/03/2021 02:30"], X.convert_column_to_datetime) == [
            dt.datetime(2021, 3, 28, 2, 30)
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_to_int(spark, table):
    texts = ["5", " 7 ", "-3", "+4", "1_000", "5.0", "x", "", None, "99999999999999999999"]
    assert converted(spark, texts, lambda df, c: X.convert_column_to_int(df, c, on_error="null")) == [5, 7, -3, 4, 1000, None, None, None, None, None]
    assert column(X.convert_column_to_int(table, "v", on_error="null"), "v") == [1, None, 0]


def test_to_float(spark, table):
    texts = ["5", " 7.25 ", "-.5", "1e3", "1_000.5", "8,75", "1.5d", "0x1p3", "nan", "inf", None]
    assert converted(spark, texts, lambda df, c: X.convert_column_to_float(df, c, on_error="null")) == [
        5.0, 7.25, -0.5, 1000.0, 1000.5, None, None, None, None, float("inf"), None,
    ]
    assert column(X.convert_column_to_float(table, "n", on_error="null"), "n") == [1.0, 2.0, None]


@pytest.mark.parametrize("convert", [X.convert_column_to_int, X.convert_column_to_float])
def test_conversions_are_all_or_nothing(spark, convert):
    assert converted(spark, ["5", None, " 7"], convert) == [5, None, 7]
    with pytest.raises(Exception, match="does not convert"):
        converted(spark, ["5", "x"], convert)


def test_overflow_fails_or_is_missing(spark):
    df = spark.createDataFrame([(2**63 - 1, 1), (1, 1)], "a long, b long")
    with pytest.raises(Exception, match="(?i)overflow"):
        X.sum_value(df, "a", 1).collect()
    assert column(X.sum_value(df, "a", 1, on_overflow="null"), "a") == [None, 2]
    assert column(X.sum_cols(df, "a", "b", "c", on_overflow="null"), "c") == [None, 2]
    assert [r[0] for r in df.select(X.overflows(df, "sum", "a", 1)).collect()] == [True, False]


def test_large_literal_mapping_runs_no_job(spark):
    df = spark.range(100)
    mapping = {k: f"v{k}" for k in range(50)}
    spark.sparkContext.setJobGroup("mapping", "mapping")
    done = apply_plan(df, [step("map_col_values", column="id", mapping=mapping)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("mapping")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["id"] or "" for r in done.df.collect()) == sorted([f"v{k}" for k in range(50)] + [""] * 50)


def test_conversion_failures(spark):
    df = spark.createDataFrame([("5",), ("x",), ("nan",), (None,)], "t string").coalesce(1)

    def marks(target, strict=False):
        return [r[0] for r in df.select(X.conversion_failures(df, "t", target, strict=strict)).collect()]

    assert marks("int") == [False, True, True, False]
    assert marks("int", strict=True) == [False, True, True, True]
    assert marks("float") == [False, True, False, False]
    assert marks("datetime") == [True, True, True, False]
    assert X.conversion_failures(spark.range(1), "id", "int") is None


def test_conversion_needs_a_fitting_type(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t, 1 as n")
    for step, name in ((X.convert_column_to_int, "t"), (X.convert_column_to_float, "t"), (X.convert_column_to_datetime, "n")):
        with pytest.raises(ValueError):
            step(df, name)


def test_column_arithmetic(spark):
    df = spark.createDataFrame([(7, 2, 0.5), (1, None, -3.0), (2**31 - 1, 1, 4.0)], "a int, b int, f double").coalesce(1)
    assert column(X.sum_cols(df, "a", "b", "s"), "s") == [9, None, 2**31]
    assert column(X.subtract_cols(df, "a", "f", "s"), "s") == [6.5, 4.0, 2**31 - 5.0]
    assert column(X.multiply_cols(df, "a", "b", "s"), "s") == [14, None, 2**31 - 1]
    assert column(X.power_cols(df, "b", "f", "s"), "s") == [2**0.5, None, 1.0]
    assert column(X.divide_cols(df, "a", "f", "s"), "s") == [7.0, 1.0, (2**31 - 1) / 4]
    assert column(X.divide_cols(df, "a", "b", "s"), "s") == [3.5, None, 2.0**31 - 1]


def test_safe_arithmetic(spark):
    df = spark.createDataFrame([(2**62, 2**62)], "a long, b long")
    assert int(X.sum_cols(df, "a", "b", "s", safe=True).first()["s"]) == 2**63
    assert int(X.multiply_value(df, "a", 4, safe=True).first()["a"]) == 2**64


@pytest.mark.parametrize("step", [X.sum_cols, X.subtract_cols, X.multiply_cols, X.divide_cols, X.power_cols])
def test_column_arithmetic_guards(table, step):
    with pytest.raises(ValueError, match="not in the table"):
        step(table, "n", "nope", "s")
    with pytest.raises(ValueError, match="already exists"):
        step(table, "n", "v", "a")
    with pytest.raises(ValueError, match="not numeric"):
        step(table, "n", "A", "s")


def test_constants(spark):
    df = spark.createDataFrame([(8, 2.0), (None, float("nan"))], "n int, v double").coalesce(1)
    assert column(X.subtract_value(df, "n", 10), "n") == [-2, None]
    assert column(X.sum_value(df, "n", 0.5), "n") == [8.5, None]
    assert column(X.multiply_value(df, "n", 3), "n") == [24, None]
    assert column(X.divide_value(df, "n", 5), "n") == [1.6, None]
    assert column(X.divide_value(df, "n", 0), "n") == [None, None]
    assert column(X.power_value(df, "n", -1), "n") == [0.125, None]
    assert column(X.power_value(df, "n", 2), "n") == [64.0, None]


@pytest.mark.parametrize("step", [X.sum_value, X.subtract_value, X.multiply_value, X.divide_value, X.power_value])
def test_constant_guards(table, step):
    with pytest.raises(ValueError, match="not numeric"):
        step(table, "A", 1)
    with pytest.raises(ValueError, match="frozen"):
        step(table, "n", 1, frozen={"n"})
    with pytest.raises(ValueError, match="not a number"):
        step(table, "n", "1")


def test_map_values(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("b", 2, -0.0), (None, None, None)], "s string, n int, f double").coalesce(1)
    assert column(X.map_col_values(df, "s", {"a": 1}), "s") == [1, None, None]
    assert column(X.map_col_values(df, "n", {"1": "one", "2.0": "two"}), "n") == ["one", "two", None]
    assert column(X.map_col_values(df, "f", {"0": 1.5}), "f") == [1.5, 1.5, None]
    assert column(X.map_col_values(df, "s", {"a": True, "b": None}), "s") == [True, None, None]
    for bad in ({}, {"a": 1, "b": "x"}, {1: 2}):
        with pytest.raises(ValueError):
            X.map_col_values(df, "s", bad)
    with pytest.raises(ValueError, match="does not fit"):
        X.map_col_values(df, "n", {"x": 1})


def test_large_mapping_is_joined(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as s", "id")
    out = X.map_col_values(df, "s", {str(i): i * 10 for i in range(500)})
    assert rows(out.where("s is not null").selectExpr("sum(s)", "count(*)")) == [(sum(range(500)) * 10, 500)]
    assert out.columns == ["s", "id"] and out.count() == 1000


@pytest.mark.parametrize("small", [None, True, False])
def test_map_from_table(spark, small):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, other string")
    names = spark.createDataFrame([(1, "one"), (3, "three"), (None, "none")], "id int, name string")
    out = X.map_from_table(df, "k", names, "id", "name", small=small)
    assert rows(out) == [("one", "x"), (None, "y"), (None, "z")]
    with pytest.raises(ValueError, match="more than once"):
        X.map_from_table(df, "k", names.union(names), "id", "name", small=small)
