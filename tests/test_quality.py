import numpy as np
import pandas as pd
import pytest
from conftest import rows

from tidemark.functions import quantiles
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import quality as Q
from pyspark.sql import functions as F


def test_duplicates_treat_missing_as_equal(spark):
    data = [(1, None), (1, None), (1, float("nan")), (2, 0.0), (2, -0.0), (3, 1.0)]
    df = spark.createDataFrame(data, "a int, v double")
    assert rows(Q.duplicate_rows(df)) == [(3,)]
    assert rows(Q.duplicate_rows(df, ["a", "a", "nope"])) == [(3,)]
    assert rows(Q.duplicate_rows(df.limit(0))) == [(0,)]
    with pytest.raises(ValueError, match="None of"):
        Q.duplicate_rows(df, ["nope"])


def test_duplicates_of_long_texts(spark):
    df = spark.createDataFrame([("a" * 200,), ("a" * 200,), ("a" * 199 + "b",)], "t string")
    assert rows(Q.duplicate_rows(df)) == [(1,)]


def test_value_types_typed(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "n int, s string")
    assert rows(Q.value_types(df, "n")) == [("int", 1)]
    assert rows(Q.value_types(df, "s")) == [("str", 2)]


def test_value_types_json(spark):
    texts = ['{"k": 1}', "[1]", "1", "1.5", "true", '"x"', "null", "not json", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows(Q.value_types(df, "t", read="json")) == [
        ("bool", 1), ("dict", 1), ("float", 1), ("int", 1), ("list", 1), ("str", 2),
    ]


def test_value_types_literal(spark):
    texts = ["5", " -7 ", "5.0", "1e3", "true", "2024-01-31", "x", "", None, "1_000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows(Q.value_types(df, "t", read="literal")) == [
        ("bool", 1), ("datetime", 1), ("float", 2), ("int", 2), ("str", 3),
    ]
    with pytest.raises(ValueError):
        Q.value_types(df, "t", read="guess")


def test_top_values_ties_and_missing(spark):
    data = [("b",), ("b",), ("a",), ("a",), (None,), (None,), (None,), ("c",)]
    df = spark.createDataFrame(data, "t string")
    assert [tuple(r) for r in Q.top_values(df, "t", 3).collect()] == [(None, 3), ("a", 2), ("b", 2)]


def test_top_values_limit(spark):
    df = spark.range(120).selectExpr("cast(id % 60 as int) as v", "cast(id as double) as d", "id % 2 = 0 as even")
    assert Q.top_values(df, "v").count() == 50
    out = Q.top_values_all(df).collect()
    assert len([r for r in out if r["column"] == "v"]) == 50
    assert sorted(r["value"] for r in out if r["column"] == "even") == ["False", "True"]
    assert {r["value"] for r in out if r["column"] == "d"} <= {f"{i}.0" for i in range(120)}


def test_top_values_all_merges_signed_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,), (1e7,)], "d double")
    assert rows(Q.top_values_all(df).select("value", "n")) == [("0.0", 2), ("10000000.0", 1), (None, 2)]


def test_missing_patterns(spark):
    data = [(None, "x", "p"), (1.0, "x", "p"), (float("nan"), "y", "q"), (2.0, None, "q")]
    df = spark.createDataFrame(data, "v double, g string, h string")
    assert rows(Q.missing_patterns(df, "v")) == [
        ("g", "x", 2, 0.5), ("g", "y", 1, 1.0), ("h", "p", 2, 0.5), ("h", "q", 2, 0.5),
    ]
    assert rows(Q.missing_patterns(df.dropna(), "v")) == []
    assert rows(Q.missing_patterns(df.select("v"), "v")) == []


def numpy_outliers(values):
    q1, q3 = np.quantile(values, [0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return q1, q3, int((values < low).sum()), int((values > high).sum())


@pytest.mark.parametrize("kept", [20, 10_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "gap", "cluster", "two", "one"])
def test_outliers_against_numpy(spark, monkeypatch, kind, kept):
    """A gap at the quartiles, clusters beside far outliers, and brackets of a few values."""
    monkeypatch.setattr(quantiles, "KEPT", kept)
    rng = np.random.default_rng(5)
    values = {
        "normal": rng.normal(size=30001),
        "ties": rng.integers(0, 4, 20000).astype(float),
        "heavy": np.exp(rng.normal(0, 6, 10000)),
        "gap": np.concatenate([rng.normal(size=250), 1e9 + rng.normal(size=500), 2e9 + rng.normal(size=250)]),
        "cluster": np.concatenate([1e-12 * rng.random(5000), [1e300, -1e300], 5 + 1e-9 * rng.random(5000)]),
        "two": np.array([1.0, 4.0]),
        "one": np.array([3.0]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    out = Q.iqr_outliers(df, ["v"]).first()
    q1, q3, n_low, n_high = numpy_outliers(values)
    assert out["q1"] == pytest.approx(q1, rel=1e-12)
    assert out["q3"] == pytest.approx(q3, rel=1e-12)
    assert (out["n_lower"], out["n_upper"], out["n_valid"]) == (n_low, n_high, len(values))
    assert out["outlier_percentage"] == pytest.approx((n_low + n_high) * 100 / len(values))


def test_outlier_messages(spark):
    df = spark.createDataFrame([(None, "x", True, float("nan"))], "v double, t string, b boolean, n double")
    out = {r["column"]: r["message"] for r in Q.iqr_outliers(df, ["v", "t", "b", "n"]).collect()}
    assert out["v"] == out["n"] == "no valid values"
    assert "not numeric" in out["t"] and "not numeric" in out["b"]
    assert Q.iqr_outliers(df, ["t"]).first()["q1"] is None


def test_approximate_outliers(spark):
    df = spark.range(10001).selectExpr("cast(id as double) as v")
    out = Q.iqr_outliers(df, approx=True).first()
    assert out["q1"] == pytest.approx(2500, abs=10)


@pytest.mark.parametrize("few", [True, False, None])
def test_grouped_quantiles(spark, few):
    """One group holds most rows, and one group's key is NULL."""
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"g": ["hot"] * 20000 + ["cold"] * 300 + [None] * 50, "v": rng.gamma(0.3, 100, 20350)})
    df = spark.createDataFrame(frame, "g string, v double").repartition(6)
    probabilities = [0.0, 0.1, 0.5, 0.999, 1.0]
    out = exact_quantiles(df, ["g"], F.col("v"), probabilities, few_groups=few, kept=50, also={"mean": F.avg})
    found = {r["g"]: r for r in out.collect()}
    for key, part in frame.groupby("g", dropna=False):
        got = found[key if isinstance(key, str) else None]
        assert got["n"] == len(part)
        assert got["mean"] == pytest.approx(part["v"].mean())
        assert got["quantiles"] == pytest.approx(list(np.quantile(part["v"], probabilities)), rel=1e-9)


def test_quantiles_with_infinities(spark):
    values = [float("-inf")] + [float(i) for i in range(999)] + [float("inf")]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    out = exact_quantiles(df, ["g"], F.col("v"), [0.0, 0.5, 1.0], few_groups=True, kept=20).first()
    assert out["quantiles"] == [float("-inf"), 499.0, float("inf")]
