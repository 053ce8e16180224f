import pytest
from conftest import rows
from pyspark.sql import types as T

from tidemark.operators import contracts as C


@pytest.mark.parametrize(
    "dtype, category",
    [
        (T.LongType(), "numeric"),
        (T.DecimalType(10, 2), "numeric"),
        (T.BooleanType(), "boolean"),
        (T.DateType(), "datetime"),
        (T.TimestampNTZType(), "datetime"),
        (T.StringType(), "string"),
        (T.ArrayType(T.LongType()), "object"),
        (T.BinaryType(), "other"),
    ],
)
def test_categories(dtype, category):
    assert C.dtype_category(dtype) == category


@pytest.fixture(scope="module")
def table(spark):
    data = [(1, 1.5, "x", True, None), (2, float("nan"), "x", False, None), (3, 2.5, None, True, None)]
    return spark.createDataFrame(data, "n int, v double, `s.t` string, b boolean, e double")


def check(df, lineage=None, **expectations):
    wide = C.check_contract(df, C.TableContract(**expectations), lineage).first().asDict()
    contract = C.TableContract(**expectations)
    long = {r["check"]: r["passed"] for r in C.check_contract_rows(df, contract, lineage).collect()}
    assert wide == long
    assert rows(C.contract_met(df, contract, lineage)) == [(all(wide.values()),)]
    return wide


def test_dtypes(table):
    assert check(table, dtypes={"n": "numeric", "s.t": "string", "b": "boolean", "v": "string", "gone": "numeric"}) == {
        "n_dtype_is_numeric": True,
        "s.t_dtype_is_string": True,
        "b_dtype_is_boolean": True,
        "v_dtype_is_string": False,
        "gone_dtype_is_numeric": False,
    }
    assert check(table, dtypes={"b": "numeric"}) == {"b_dtype_is_numeric": True}


def test_nulls(table):
    assert check(table, not_all_null=("v", "e", "gone"), no_nulls=("n", "v")) == {
        "v_doesnt_has_nulls": True,
        "e_doesnt_has_nulls": False,
        "gone_doesnt_has_nulls": False,
        "n_has_no_nulls": True,
        "v_has_no_nulls": False,
    }


def test_cardinality_and_range(table):
    assert check(
        table,
        cardinality={"v": 2, "s.t": 1, "e": 0, "n": 2},
        ranges={"n": (1, 3), "v": (0, 10), "s.t": (0, 1), "b": (0, 1), "e": (0, 1)},
    ) == {
        "v_cardinality_is_2": True,
        "s.t_cardinality_is_1": True,
        "e_cardinality_is_0": True,
        "n_cardinality_is_2": False,
        "n_is_between_1_and_3": True,
        "v_is_between_0_and_10": False,  # a missing cell lies in no range
        "s.t_is_between_0_and_1": False,
        "b_is_between_0_and_1": True,
        "e_is_between_0_and_1": False,
    }
    assert check(table, ranges={"n": (1, 2)}) == {"n_is_between_1_and_2": False}


def test_renamed_and_empty(table):
    assert check(table, {"old": "n"}, cardinality={"old": 3}, dtypes={"old": "numeric"}) == {
        "old_dtype_is_numeric": True,
        "old_cardinality_is_3": True,
    }
    empty = check(table.limit(0), not_all_null=("n",), no_nulls=("n",), cardinality={"n": 0}, ranges={"n": (5, 6)})
    assert empty == {
        "n_doesnt_has_nulls": False,
        "n_has_no_nulls": True,
        "n_cardinality_is_0": True,
        "n_is_between_5_and_6": True,
    }
