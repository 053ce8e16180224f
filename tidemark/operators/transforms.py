"""Column steps: each takes a table and arguments, checks them, and returns the new table.

Only the schema is looked at; the result is a lazy projection. `frozen` names columns that
must stay as they are.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import convert
from tidemark.functions.cells import as_text, cell, is_float, is_numeric, known, literal_rows, missing, type_of
from tidemark.functions.guards import require_column, require_editable, require_new, require_numeric
from tidemark.functions.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join

# A literal mapping up to this size becomes one map expression, which is searched from its start
# for every row; a larger one is joined by hash.
LITERAL_MAPPING = 32


def _set(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace the column in place; its position and exact name stay."""
    return df.select(*[value.alias(name) if c == name else cell(c) for c in df.columns])


def _add(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", value.alias(name))


def rename_column(df: DataFrame, column: str, new_column: str, frozen: Iterable[str] = ()) -> DataFrame:
    require_editable(df, column, frozen)
    if new_column == column:
        raise ValueError(f"Column '{new_column}' already exists in the table.")
    require_new(df, new_column, besides=[column])
    return df.select(*[cell(c).alias(new_column) if c == column else cell(c) for c in df.columns])


def drop_column(df: DataFrame, column: str, frozen: Iterable[str] = ()) -> DataFrame:
    require_editable(df, column, frozen)
    return df.select(*[cell(c) for c in df.columns if c != column])


def replace_substring(
    df: DataFrame, column: str, old_substring: str, new_substring: str, frozen: Iterable[str] = ()
) -> DataFrame:
    """Literal replacement in the cell's text; missing cells stay missing."""
    require_editable(df, column, frozen)
    if old_substring == "":
        raise ValueError("The substring to replace is empty; map the values instead.")
    text = as_text(known(df, column), type_of(df, column))
    return _set(df, column, F.replace(text, F.lit(old_substring), F.lit(new_substring)))


def imputed_flag(column: str) -> str:
    return f"imputed_{column}"


def _fill_literal(value: Any, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """The literal, and the type the column takes; a value of another kind is an error."""
    fits = False
    target = dtype
    if isinstance(value, bool):
        fits = isinstance(dtype, T.BooleanType)
    elif isinstance(value, int):
        fits = is_numeric(dtype)
        if isinstance(dtype, T.IntegralType):
            target = T.LongType()
    elif isinstance(value, float):
        fits = is_numeric(dtype)
        if isinstance(dtype, T.IntegralType):
            target = T.LongType() if value.is_integer() else T.DoubleType()
    elif isinstance(value, str):
        fits = isinstance(dtype, T.StringType)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            value, fits = dt.datetime.fromisoformat(value), True
    elif isinstance(value, (dt.date, dt.datetime)):
        fits = isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if not fits:
        raise ValueError(f"{value!r} cannot fill a column of type {dtype.simpleString()}.")
    return F.lit(value).cast(target), target


def fill_col_na(df: DataFrame, column: str, fill_value: Any, frozen: Iterable[str] = ()) -> DataFrame:
    """Fill missing cells and mark the rows in `imputed_<column>`.

    The caller freezes that flag. A later fill of the same column keeps the earlier marks.
    """
    require_editable(df, column, frozen)
    literal, target = _fill_literal(fill_value, type_of(df, column))
    flag = imputed_flag(column)
    gap = missing(df, column)
    filled = F.coalesce(known(df, column).cast(target), literal)
    if flag in df.columns and flag in frozen:
        changed = {column: filled, flag: cell(flag) | gap}
        return df.select(*[changed[c].alias(c) if c in changed else cell(c) for c in df.columns])
    require_new(df, flag)
    return df.select(*[filled.alias(c) if c == column else cell(c) for c in df.columns], gap.alias(flag))


def convert_column_to_datetime(
    df: DataFrame,
    column: str,
    formats: Sequence[str] = convert.DATE_FORMATS,
    frozen: Iterable[str] = (),
) -> DataFrame:
    """Cells that fit none of the layouts become NULL."""
    require_editable(df, column, frozen)
    dtype = type_of(df, column)
    if not isinstance(dtype, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"Column '{column}' is {dtype.simpleString()}; only text converts to datetime.")
    return _set(df, column, convert.to_datetime(cell(column), dtype, formats))


def _require_number_like(df: DataFrame, column: str, target: str) -> None:
    dtype = type_of(df, column)
    if not (is_numeric(dtype) or isinstance(dtype, (T.StringType, T.BooleanType))):
        raise ValueError(f"Column '{column}' is {dtype.simpleString()} and does not convert to {target}.")


def _all_or_nothing(df: DataFrame, column: str, target: str, value: Column, on_error: str) -> DataFrame:
    if on_error not in ("refuse", "null"):
        raise ValueError(f"on_error must be refuse or null, not {on_error!r}")
    bad = conversion_failures(df, column, target) if on_error == "refuse" else None
    if bad is not None:
        text = F.substring(as_text(cell(column), type_of(df, column)), 1, 100)
        message = F.concat(F.lit(f"Column '{column}' does not convert to {target}: "), text)
        kind = "long" if target == "int" else "double"
        value = F.when(bad, F.raise_error(message).cast(kind)).otherwise(value)
    return _set(df, column, value)


def convert_column_to_int(df: DataFrame, column: str, frozen: Iterable[str] = (), on_error: str = "refuse") -> DataFrame:
    """Whole numbers, all or nothing: a cell that is none fails the query when its row is computed.

    `on_error="null"` makes such cells missing instead; the plan runner uses it, as it counts them
    first and rejects the step, and streams do, where a whole column can't be checked.
    """
    require_editable(df, column, frozen)
    _require_number_like(df, column, "int")
    return _all_or_nothing(df, column, "int", convert.to_int(known(df, column), type_of(df, column)), on_error)


def convert_column_to_float(df: DataFrame, column: str, frozen: Iterable[str] = (), on_error: str = "refuse") -> DataFrame:
    """Floats, all or nothing as `convert_column_to_int`; `nan` is a missing number and no failure."""
    require_editable(df, column, frozen)
    _require_number_like(df, column, "float")
    return _all_or_nothing(df, column, "float", convert.to_float(known(df, column), type_of(df, column)), on_error)


def conversion_failures(
    df: DataFrame, column: str, target: str, strict: bool = False, formats: Sequence[str] = convert.DATE_FORMATS
) -> Column | None:
    """Boolean column: this cell has a value that the target type cannot hold.

    None when the column's type rules that out. `strict` counts missing cells too for `int`.
    """
    dtype = type_of(df, column)
    value = known(df, column)
    if target == "datetime":
        if not isinstance(dtype, T.StringType):
            return None
        return value.isNotNull() & convert.to_datetime(value, dtype, formats).isNull()
    if target == "float":
        if not isinstance(dtype, T.StringType):
            return None
        return value.isNotNull() & convert.to_float(value, dtype).isNull() & ~convert.spells_nan(value, dtype)
    lossless = isinstance(dtype, (T.IntegralType, T.BooleanType))
    if lossless and not strict:
        return None
    bad = value.isNotNull() & convert.to_int(value, dtype).isNull()
    return bad | missing(df, column) if strict else bad


_EXACT = {
    "sum": (F.try_add, lambda a, b: a + b),
    "subtract": (F.try_subtract, lambda a, b: a - b),
    "multiply": (F.try_multiply, lambda a, b: a * b),
}


def _computed(kind: str, a: Column, b: Column, on_overflow: str) -> Column:
    """The result; where it exceeds its type the query fails, or with `null` the cell is missing."""
    if on_overflow not in ("fail", "null"):
        raise ValueError(f"on_overflow must be fail or null, not {on_overflow!r}")
    quiet, strict = _EXACT[kind]
    return quiet(a, b) if on_overflow == "null" else strict(a, b)


def overflows(df: DataFrame, kind: str, first: str, second: str | int | float, safe: bool = False) -> Column | None:
    """Boolean column: this row's result exceeds its type. None for floats, which have no such end."""
    exact = (T.IntegralType, T.DecimalType)
    if not isinstance(type_of(df, first), exact):
        return None
    a = _widened(df, first, safe)
    if isinstance(second, str):
        if not isinstance(type_of(df, second), exact):
            return None
        b = _widened(df, second, safe)
    elif isinstance(second, int):
        b = F.lit(second).cast("long")
    else:
        return None
    return a.isNotNull() & b.isNotNull() & _EXACT[kind][0](a, b).isNull()


def _widened(df: DataFrame, name: str, safe: bool) -> Column:
    """Whole numbers compute as 64 bit, or as 38 digits when `safe`."""
    if isinstance(type_of(df, name), T.IntegralType):
        return cell(name).cast("decimal(38,0)" if safe else "long")
    return cell(name)


def _two_columns(df: DataFrame, first_col: str, second_col: str, new_col_name: str) -> None:
    require_column(df, first_col)
    require_column(df, second_col)
    require_new(df, new_col_name)
    require_numeric(df, first_col, second_col)


def subtract_cols(
    df: DataFrame, first_col: str, second_col: str, new_col_name: str, safe: bool = False, on_overflow: str = "fail"
) -> DataFrame:
    _two_columns(df, first_col, second_col, new_col_name)
    a, b = _widened(df, first_col, safe), _widened(df, second_col, safe)
    return _add(df, new_col_name, _computed("subtract", a, b, on_overflow))


def sum_cols(
    df: DataFrame, first_col: str, second_col: str, new_col_name: str, safe: bool = False, on_overflow: str = "fail"
) -> DataFrame:
    _two_columns(df, first_col, second_col, new_col_name)
    a, b = _widened(df, first_col, safe), _widened(df, second_col, safe)
    return _add(df, new_col_name, _computed("sum", a, b, on_overflow))


def multiply_cols(
    df: DataFrame, first_col: str, second_col: str, new_col_name: str, safe: bool = False, on_overflow: str = "fail"
) -> DataFrame:
    _two_columns(df, first_col, second_col, new_col_name)
    a, b = _widened(df, first_col, safe), _widened(df, second_col, safe)
    return _add(df, new_col_name, _computed("multiply", a, b, on_overflow))


def divide_cols(df: DataFrame, first_col: str, second_col: str, new_col_name: str) -> DataFrame:
    """Denominators below 1 count as 1; a missing one gives a missing result."""
    _two_columns(df, first_col, second_col, new_col_name)
    below = known(df, second_col).cast("double")
    floor_one = F.when(below.isNotNull(), F.greatest(below, F.lit(1.0)))
    return _add(df, new_col_name, known(df, first_col).cast("double") / floor_one)


def power_cols(df: DataFrame, first_col: str, second_col: str, new_col_name: str) -> DataFrame:
    _two_columns(df, first_col, second_col, new_col_name)
    return _add(df, new_col_name, F.pow(cell(first_col).cast("double"), cell(second_col).cast("double")))


def _constant(df: DataFrame, column: str, value: int | float, frozen: Iterable[str]) -> Column:
    require_editable(df, column, frozen)
    require_numeric(df, column)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{value!r} is not a number.")
    return F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)


def subtract_value(
    df: DataFrame,
    column: str,
    value: int | float,
    frozen: Iterable[str] = (),
    safe: bool = False,
    on_overflow: str = "fail",
) -> DataFrame:
    constant = _constant(df, column, value, frozen)
    return _set(df, column, _computed("subtract", _widened(df, column, safe), constant, on_overflow))


def sum_value(
    df: DataFrame,
    column: str,
    value: int | float,
    frozen: Iterable[str] = (),
    safe: bool = False,
    on_overflow: str = "fail",
) -> DataFrame:
    constant = _constant(df, column, value, frozen)
    return _set(df, column, _computed("sum", _widened(df, column, safe), constant, on_overflow))


def multiply_value(
    df: DataFrame,
    column: str,
    value: int | float,
    frozen: Iterable[str] = (),
    safe: bool = False,
    on_overflow: str = "fail",
) -> DataFrame:
    constant = _constant(df, column, value, frozen)
    return _set(df, column, _computed("multiply", _widened(df, column, safe), constant, on_overflow))


def divide_value(df: DataFrame, column: str, value: int | float, frozen: Iterable[str] = ()) -> DataFrame:
    """Division by zero gives NULL."""
    constant = _constant(df, column, value, frozen)
    return _set(df, column, F.try_divide(cell(column).cast("double"), constant.cast("double")))


def power_value(df: DataFrame, column: str, value: int | float, frozen: Iterable[str] = ()) -> DataFrame:
    constant = _constant(df, column, value, frozen)
    return _set(df, column, F.pow(cell(column).cast("double"), constant.cast("double")))


def _value_type(values: Iterable[Any]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool}:
        return T.BooleanType() if kinds else T.StringType()
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds <= {str}:
        return T.StringType()
    raise ValueError(f"A mapping needs one type of value, not {sorted(k.__name__ for k in kinds)}.")


def _typed_key(key: Any, dtype: T.DataType) -> Any:
    """The key in the column's type; keys of a mapping read from JSON are always text."""
    try:
        if isinstance(dtype, T.StringType):
            if isinstance(key, str):
                return key
        elif isinstance(dtype, T.BooleanType):
            if isinstance(key, bool):
                return key
            if str(key).lower() in ("true", "false"):
                return str(key).lower() == "true"
        elif isinstance(dtype, T.IntegralType):
            number = decimal.Decimal(str(key))
            if number == number.to_integral_value():
                return int(number)
        elif is_float(dtype):
            return float(key)
        elif isinstance(dtype, T.DecimalType):
            return decimal.Decimal(str(key))
    except (ValueError, ArithmeticError):
        pass
    raise ValueError(f"Mapping key {key!r} does not fit a column of type {dtype.simpleString()}.")


def map_col_values(
    df: DataFrame, column: str, mapping: Mapping[Any, Any], frozen: Iterable[str] = ()
) -> DataFrame:
    """Replace values by the mapping; values not in it, and missing cells, become missing."""
    require_editable(df, column, frozen)
    if not mapping:
        raise ValueError("The mapping is empty.")
    dtype = type_of(df, column)
    target = _value_type(mapping.values())
    typed = {_typed_key(k, dtype): v for k, v in mapping.items()}
    if len(typed) > LITERAL_MAPPING:
        schema = T.StructType([T.StructField("__key", dtype), T.StructField("__value", target)])
        rows = [(k, float(v) if isinstance(target, T.DoubleType) and v is not None else v) for k, v in typed.items()]
        entries = literal_rows(df.sparkSession, rows, schema)
        # The size is known, so nothing is measured and no job runs; a stream takes it too.
        size = sum(len(str(k)) + len(str(v)) + 32 for k, v in rows)
        small = len(rows) <= BROADCAST_ROWS and size <= BROADCAST_BYTES
        return _mapped_by_join(df, column, entries, small, spread=False)
    pairs = [x for k, v in typed.items() for x in (F.lit(k).cast(dtype), F.lit(v).cast(target))]
    key = known(df, column)
    if is_float(dtype):
        key = key + F.lit(0.0).cast(dtype)  # -0.0 finds 0.0
    return _set(df, column, F.try_element_at(F.create_map(*pairs), key))


def map_from_table(
    df: DataFrame,
    column: str,
    table: DataFrame,
    key: str,
    value: str,
    frozen: Iterable[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """`map_col_values` with the mapping in a table of one row per key.

    A table that names a key twice is an error, as rows would multiply. The table is
    broadcast when its measured size allows, else joined with hot keys spread out.
    """
    require_editable(df, column, frozen)
    require_column(table, key)
    require_column(table, value)
    entries = table.where(cell(key).isNotNull()).select(cell(key).alias("__key"), cell(value).alias("__value"))
    repeated = entries.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError("The mapping table holds a key more than once.")
    return _mapped_by_join(df, column, entries, small)


def _mapped_by_join(
    df: DataFrame, column: str, entries: DataFrame, small: bool | None, spread: bool = True
) -> DataFrame:
    """Replace the column by `__value` of the entry with its `__key`; keys are unique."""
    key = known(df, column)
    if is_float(type_of(df, column)):
        key = key + F.lit(0.0).cast(type_of(df, column))  # -0.0 finds 0.0
    joined = lookup_join(df.select("*", key.alias("__key")), entries, ["__key"], "left", small, spread)
    return joined.select(*[F.col("__value").alias(c) if c == column else cell(c) for c in df.columns])
