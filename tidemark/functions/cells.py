"""Expressions on single cells: quoting, missing values, text forms, group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Texts at least this long are grouped by their SHA-256 digest (64 hex characters), so
# that a shuffle on a text column moves 64 characters per row, not whole documents.
# Shorter texts stay as they are; the two kinds cannot meet, as their lengths differ.
DIGEST_FROM = 64

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cell(name: str) -> Column:
    """The column of exactly this name; dots and spaces are part of the name."""
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def known(df: DataFrame, name: str) -> Column:
    """The cell with NaN turned into NULL: both count as missing."""
    dtype = type_of(df, name)
    if is_float(dtype):
        return F.nanvl(cell(name), F.lit(None).cast(dtype))
    return cell(name)


def missing(df: DataFrame, name: str) -> Column:
    if is_float(type_of(df, name)):
        return cell(name).isNull() | F.isnan(cell(name))
    return cell(name).isNull()


def as_text(value: Column, dtype: T.DataType) -> Column:
    """The text a notebook user expects: `True`, `10000000.0`, `1e-05`; NULL stays NULL."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, NESTED):
        return F.to_json(value)
    text = value.cast("string")
    if not is_float(dtype):
        return text
    # Spark writes 1.0E7 from 10^7 on and below 10^-3; plain digits are wanted from 10^-4 up to 10^16.
    size = F.abs(value)
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    power = F.substring_index(text, "E", -1).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""),
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def plain_key(df: DataFrame, name: str) -> Column:
    """A text that is equal for equal cells and NULL for missing ones."""
    dtype = type_of(df, name)
    value = known(df, name)
    if is_float(dtype):
        text = (value + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are the same value
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(value)
    elif isinstance(dtype, NESTED):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return text


def key_text(df: DataFrame, name: str) -> Column:
    """`plain_key`, and short for long texts."""
    if isinstance(type_of(df, name), (T.StringType, T.BinaryType, *NESTED)):
        return digest_long(plain_key(df, name))
    return plain_key(df, name)


def digest_long(text: Column) -> Column:
    return F.when(F.length(text) >= DIGEST_FROM, F.sha2(text, 256)).otherwise(text)


def row_key(df: DataFrame, name: str) -> Column:
    """The cell as a grouping key in its own type; long texts by digest, missing as NULL."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.StringType, T.BinaryType, *NESTED)):
        return key_text(df, name)
    return known(df, name)


def long_form(df: DataFrame, values: dict[str, Column], ids: Sequence[Column] = ()) -> DataFrame:
    """Rows `(ids…, column, value)`, one per table cell; all values must share a type."""
    wide = df.select(*ids, *[expr.alias(name) for name, expr in values.items()])
    id_names = wide.columns[: len(ids)]
    return wide.unpivot([cell(n) for n in id_names], [cell(n) for n in values], "column", "value")


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Display view: the named columns rounded half up."""
    return df.withColumns({c: F.round(cell(c), digits) for c in columns})


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A few given rows in one partition; left alone, a cluster would start a task per core for them."""
    return spark.createDataFrame(list(rows), schema).coalesce(1)
