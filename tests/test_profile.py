import pytest
from conftest import rows

from tidemark.operators import profile as P


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [
            (1, "x", float("nan"), True, None),
            (2, "x", -0.0, None, None),
            (3, None, 0.0, False, None),
            (4, "nan", None, True, None),
            (4, "y" * 100, 2.5, True, None),
            (4, "y" * 99 + "z", 1e7, True, None),
        ],
        "`a.b` int, `my col` string, v double, flag boolean, empty string",
    )


def test_profile(odd):
    out = {r["column"]: r for r in P.profile(odd, sample_rows=3).collect()}
    assert [(c, r["n_nulls"], r["n_unique"]) for c, r in sorted(out.items())] == [
        ("a.b", 0, 4),
        ("empty", 6, 0),
        ("flag", 1, 2),
        ("my col", 1, 4),
        ("v", 2, 3),  # NaN is missing; -0.0 and 0.0 are one value
    ]
    assert {r["n_rows"] for r in out.values()} == {6}
    assert {r["n_columns"] for r in out.values()} == {5}
    assert sum(len(r["sample"]) for r in out.values()) == 15


def test_samples_in_order(spark):
    df = spark.createDataFrame([(3, 1e7), (1, None), (2, 1e-5)], "k int, v double")
    out = {r["column"]: r["sample"] for r in P.samples(df, 5, ["k"]).collect()}
    assert out == {"k": ["1", "2", "3"], "v": [None, "1e-05", "10000000.0"]}


def test_empty_table(spark, odd):
    out = P.profile(odd.limit(0)).collect()
    assert [(r["n_rows"], r["n_nulls"], r["n_unique"], r["sample"]) for r in out] == [(0, 0, 0, [])] * 5
    assert rows(P.has_nulls(odd.limit(0), "v")) == [(False,)]
    assert rows(P.unique_counts(odd.limit(0), ["v"])) == [("v", 0)]
    assert rows(P.row_count(odd.limit(0))) == [(0,)]


def test_approximate_profile(spark):
    df = spark.range(20000).selectExpr("id", "id % 7 as small", "cast(id as string) as text")
    exact = {r["column"]: r["n_unique"] for r in P.profile(df).collect()}
    near = {r["column"]: r["n_unique"] for r in P.profile(df, approx=True).collect()}
    assert exact == {"id": 20000, "small": 7, "text": 20000}
    assert all(abs(near[c] - exact[c]) <= 0.15 * exact[c] for c in exact)


def test_null_counts(odd):
    assert rows(P.null_counts(odd)) == [("a.b", 0), ("empty", 6), ("flag", 1), ("my col", 1), ("v", 2)]


def test_single_questions(odd):
    assert P.column_count(odd) == 5
    assert P.column_names(odd)[0] == "a.b"
    assert P.column_types(odd)["v"] == "double"
    assert P.column_type(odd, "a.b") == "int"
    assert rows(P.has_nulls(odd, "v")) == [(True,)]
    assert rows(P.has_nulls(odd, "a.b")) == [(False,)]
    assert rows(P.unique_values(odd, "flag")) == [(False,), (None,), (True,)]
    assert len(rows(P.unique_values(odd, "v"))) == 4
    assert rows(P.unique_counts(odd, ["my col", "v"])) == [("my col", 4), ("v", 3)]
    assert len(rows(P.column_sample(odd, "my col", 2))) == 2


@pytest.mark.parametrize("ask", [P.has_nulls, P.unique_values, P.column_type, P.column_sample])
def test_unknown_column(odd, ask):
    with pytest.raises(ValueError, match="not in the table"):
        ask(odd, "nope")


def test_nested_and_dates(spark):
    df = spark.sql(
        "select array(1, 2) as a, date'2024-01-01' as d, timestamp_ntz'2024-01-01 10:00:00' as t, 1.50 as dec, X'00ff' as b "
        "union all select array(1, 2), null, null, 1.50, X'00fe'"
    )
    out = {r["column"]: (r["n_nulls"], r["n_unique"]) for r in P.profile(df).collect()}
    assert out == {"a": (0, 1), "d": (1, 1), "t": (1, 1), "dec": (0, 1), "b": (0, 2)}


def test_preview(spark):
    df = spark.range(100)
    assert [r[0] for r in P.preview(df, order_by=["id"]).collect()] == list(range(10))
