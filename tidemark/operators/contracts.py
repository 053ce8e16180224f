"""Data contracts: what a table must look like after its plan has run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.cells import is_numeric, known, type_of
from tidemark.operators.profile import column_counts


@dataclass(frozen=True)
class TableContract:
    """Expectations by *original* column name; renames are resolved through the lineage."""

    dtypes: Mapping[str, str] = field(default_factory=dict)
    not_all_null: tuple[str, ...] = ()
    no_nulls: tuple[str, ...] = ()
    cardinality: Mapping[str, int] = field(default_factory=dict)
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)


def dtype_category(dtype: T.DataType) -> str:
    """One of numeric, boolean, datetime, string, object, other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "object"
    return "other"


def _dtype_holds(dtype: T.DataType, expected: str) -> bool:
    """A boolean column also meets `numeric`, as its values count as 0 and 1."""
    category = dtype_category(dtype)
    return category == expected or (category == "boolean" and expected == "numeric")


def _in_range(df: DataFrame, name: str, low: float, high: float) -> Column:
    """Every row inside, ends included; a missing cell is outside; no rows is fine."""
    dtype = type_of(df, name)
    if not (is_numeric(dtype) or isinstance(dtype, T.BooleanType)):
        return F.lit(False)
    value = known(df, name).cast("int") if isinstance(dtype, T.BooleanType) else known(df, name)
    inside = F.coalesce(value.between(F.lit(low), F.lit(high)), F.lit(False))
    return F.coalesce(F.bool_and(inside), F.lit(True))


@dataclass(frozen=True)
class _Check:
    """A test: an aggregate over the table, or for a cardinality one over the counts of distinct values."""

    name: str
    kind: str
    column: str
    expected: str
    holds: Column


def _distinct(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Distinct values of each named column, as fields of one scalar.

    Cells are counted by (column, value) where they are read; counting them within the aggregation of
    the other checks would copy every row once for each column.
    """
    counts = column_counts(df, names)
    fields = [F.coalesce(F.max(F.when(F.col("column") == n, F.col("n_unique"))), F.lit(0)).alias(f"d{i}") for i, n in enumerate(names)]
    row = counts.agg(F.struct(*fields).alias("distinct")).scalar()
    return {n: row.getField(f"d{i}") for i, n in enumerate(names)}


def _checks(df: DataFrame, contract: TableContract, lineage: Mapping[str, str]) -> list[_Check]:
    """The checks as aggregates over the table. A column that is not there fails its checks."""

    def holds(column: str, test) -> Column:
        current = lineage.get(column, column)
        return test(current) if current in df.columns else F.lit(False)

    counted = [n for n in dict.fromkeys(lineage.get(c, c) for c in contract.cardinality) if n in df.columns]
    distinct = _distinct(df, counted) if counted else {}
    checks = [
        _Check(
            f"{c}_dtype_is_{t}", "dtype", c, t, holds(c, lambda n, t=t: F.lit(_dtype_holds(type_of(df, n), t)))
        )
        for c, t in contract.dtypes.items()
    ]
    checks += [
        _Check(f"{c}_doesnt_has_nulls", "not_all_null", c, "", holds(c, lambda n: F.count(known(df, n)) > 0))
        for c in contract.not_all_null
    ]
    checks += [
        _Check(
            f"{c}_has_no_nulls",
            "no_nulls",
            c,
            "",
            holds(c, lambda n: F.count(known(df, n)) == F.count(F.lit(1))),
        )
        for c in contract.no_nulls
    ]
    checks += [
        _Check(
            f"{c}_cardinality_is_{k}",
            "cardinality",
            c,
            str(k),
            holds(c, lambda n, k=k: distinct[n] == k),
        )
        for c, k in contract.cardinality.items()
    ]
    checks += [
        _Check(
            f"{c}_is_between_{low}_and_{high}",
            "range",
            c,
            f"{low}..{high}",
            holds(c, lambda n, low=low, high=high: _in_range(df, n, low, high)),
        )
        for c, (low, high) in contract.ranges.items()
    ]
    return checks


def _tested(df: DataFrame, checks: list[_Check]) -> DataFrame:
    """One row with the outcome `c0, c1, …` of every check: one aggregation, and one over distinct values."""
    direct = {f"c{i}": c for i, c in enumerate(checks) if c.kind != "cardinality"}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[c.holds.alias(n) for n, c in direct.items()])
    return row.select(*[F.col(f"c{i}") if f"c{i}" in direct else c.holds.alias(f"c{i}") for i, c in enumerate(checks)])


def check_contract(df: DataFrame, contract: TableContract, lineage: Mapping[str, str] | None = None) -> DataFrame:
    """One row with one boolean column per check."""
    checks = _checks(df, contract, lineage or {})
    return _tested(df, checks).select(*[F.col(f"c{i}").alias(c.name) for i, c in enumerate(checks)])


def check_contract_rows(
    df: DataFrame, contract: TableContract, lineage: Mapping[str, str] | None = None
) -> DataFrame:
    """The same as rows `check, kind, column, expected, passed`."""
    checks = _checks(df, contract, lineage or {})
    rows = [
        F.struct(
            F.lit(c.name).alias("check"),
            F.lit(c.kind).alias("kind"),
            F.lit(c.column).alias("column"),
            F.lit(c.expected).alias("expected"),
            F.col(f"c{i}").alias("passed"),
        )
        for i, c in enumerate(checks)
    ]
    return _tested(df, checks).select(F.inline(F.array(*rows)))


def contract_met(df: DataFrame, contract: TableContract, lineage: Mapping[str, str] | None = None) -> DataFrame:
    """One row, `passed`: all checks hold."""
    checks = _checks(df, contract, lineage or {})
    tests = [F.col(f"c{i}") for i in range(len(checks))]
    return _tested(df, checks).select(reduce(lambda a, b: a & b, tests, F.lit(True)).alias("passed"))
