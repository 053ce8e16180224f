"""Diagnostics: duplicates, value types, frequencies, missing patterns, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.cells import (
    DIGEST_FROM,
    as_text,
    cell,
    digest_long,
    is_float,
    is_numeric,
    known,
    literal_rows,
    long_form,
    missing,
    row_key,
    type_of,
)
from tidemark.functions.guards import require_column
from tidemark.functions.quantiles import ACCURACY, exact_quantiles

TOP_VALUES = 50
FENCE = 1.5


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, `n_duplicates`: rows beyond the first of each group of equal rows.

    Missing cells are equal to each other. Unknown names are ignored unless all are unknown.
    """
    wanted = df.columns if columns is None else columns
    names = [c for c in dict.fromkeys(wanted) if c in df.columns]
    if not names:
        raise ValueError(f"None of {list(wanted)} is a column; the table has {df.columns}.")
    keys = df.select(*[row_key(df, c).alias(f"k{i}") for i, c in enumerate(names)])
    groups = keys.groupBy(*keys.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def _type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.NumericType):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "str"
    if isinstance(dtype, T.ArrayType):
        return "list"
    if isinstance(dtype, (T.StructType, T.MapType)):
        return "dict"
    return dtype.simpleString()


# A JSON number as it stands in the text. Its kind hangs on its characters: a parsed value has lost
# the zeros of `2.0`, and may not hold `1E400` at all.
JSON_INT = r"^[ \t\n\r]*-?(0|[1-9][0-9]*)[ \t\n\r]*\z"
JSON_FLOAT = r"^[ \t\n\r]*-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?[ \t\n\r]*\z"


def _json_kind(text: Column) -> Column:
    """The kind of a JSON document's top value; text that is no JSON is a plain `str`."""
    shape = F.regexp_extract(F.schema_of_variant(F.try_parse_json(text)), "^[A-Z]+", 0)
    return (
        F.when(text.isNull(), None)
        .when(text.rlike(JSON_INT), "int")
        .when(text.rlike(JSON_FLOAT), "float")
        .when(shape == "VOID", None)
        .when(shape == "OBJECT", "dict")
        .when(shape == "ARRAY", "list")
        .when(shape == "BOOLEAN", "bool")
        .otherwise("str")
    )


def _literal_kind(text: Column) -> Column:
    """What a text cell spells out."""
    word = F.lower(F.trim(text))
    return (
        F.when(text.isNull(), None)
        .when(word.rlike(r"^[+-]?[0-9]+$"), "int")
        .when(word.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=e))(e[+-]?[0-9]+)?$"), "float")
        .when(word.isin("true", "false"), "bool")
        .when(word.rlike("^[0-9]{4}-[0-9]") & text.try_cast("timestamp_ntz").isNotNull(), "datetime")
        .otherwise("str")
    )


def value_types(df: DataFrame, column: str, read: str = "typed") -> DataFrame:
    """`value_type, n` over the non-missing cells.

    `typed` reports the column's own type; `json` looks into JSON text (a column of mixed
    values), `literal` at what plain text spells out.
    """
    require_column(df, column)
    dtype = type_of(df, column)
    if read == "typed":
        kind = F.when(known(df, column).isNotNull(), _type_name(dtype))
    elif read == "json":
        kind = _json_kind(cell(column).cast("string"))
    elif read == "literal":
        kind = _literal_kind(cell(column).cast("string"))
    else:
        raise ValueError(f"read must be typed, json or literal, not {read!r}")
    kinds = df.select(kind.alias("value_type")).where(F.col("value_type").isNotNull())
    return kinds.groupBy("value_type").agg(F.count("*").alias("n"))


HEAD = 32  # characters of a text that travel with its digest, to order ties


def top_values(df: DataFrame, column: str, limit: int = TOP_VALUES) -> DataFrame:
    """`value, n`: the most frequent values, missing included; ties go to the smaller value.

    Texts are counted by digest; only those that may rank are read again as they stand.
    """
    require_column(df, column)
    if isinstance(type_of(df, column), T.StringType):
        counts = _ranking_texts(df, [column], limit, F.col("value")).select("value", "n")
        return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)
    counts = df.select(known(df, column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)


def top_values_all(df: DataFrame, columns: Sequence[str] | None = None, limit: int = TOP_VALUES) -> DataFrame:
    """`column, value, n, rank` for many columns in one scan, values as text.

    Values are written out after they are counted, once each. A task keeps only its own first
    `limit` values per column before the ranking shuffle. Long texts travel as digests.
    """
    names = list(columns or df.columns)
    shown = F.col("value")
    for kind, read in (("double", "double"), ("boolean", "boolean")):
        of_kind = [c for c in names if _written_as(type_of(df, c)) == kind]
        if of_kind:
            typed = T.DoubleType() if kind == "double" else T.BooleanType()
            shown = F.when(F.col("column").isin(of_kind), as_text(F.col("value").try_cast(read), typed)).otherwise(shown)
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    ranked = _ranking_texts(df, names, limit, shown).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit)


def _ranking_texts(df: DataFrame, names: Sequence[str], limit: int, shown: Column) -> DataFrame:
    """`column, value, n` for all values that may be among the first `limit` of their column.

    Values are counted by digest and first characters, and written as `shown` says. What ranks up to
    `limit` by count and first characters, ties included, is kept, and its long texts are looked up
    in the table.
    """
    cells = long_form(df, {c: _cheap_text(df, c) for c in names})
    long = F.coalesce(F.length("value") >= DIGEST_FROM, F.lit(False))
    keyed = cells.select("column", "value", digest_long(F.col("value")).alias("key"), long.alias("long"))
    start = F.when(long, F.substring("value", 1, HEAD)).alias("start")
    counts = keyed.groupBy("column", "key", "long", start).agg(F.count("*").alias("n"))
    counts = counts.withColumn("value", F.col("key")).withColumn("value", F.when(F.col("long"), F.col("key")).otherwise(shown))
    counts = counts.withColumn("head", F.coalesce("start", F.substring("value", 1, HEAD)))
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("head"))
    kept = counts.withColumn("place", F.rank().over(order)).where(F.col("place") <= limit)
    short = kept.where(~F.col("long")).select("column", "value", "n")
    texts = [c for c in names if not isinstance(type_of(df, c), (T.NumericType, T.BooleanType, T.DatetimeType))]
    if not texts:
        return short
    wanted = kept.where(F.col("long")).select(F.col("column").alias("of"), F.col("key").alias("digest"), "n")
    same = (F.col("column") == F.col("of")) & (F.col("key") == F.col("digest"))
    found = keyed.where(F.col("long") & F.col("column").isin(texts)).join(wanted, same)
    whole = found.groupBy("column", "key").agg(F.first("value").alias("value"), F.first("n").alias("n"))
    return short.unionByName(whole.select("column", "value", "n"))


def _written_as(dtype: T.DataType) -> str:
    if is_float(dtype):
        return "double"
    return "boolean" if isinstance(dtype, T.BooleanType) else "text"


def _cheap_text(df: DataFrame, name: str) -> Column:
    """One text per value, not yet in its final form."""
    dtype = type_of(df, name)
    if is_float(dtype):
        return (known(df, name) + F.lit(0.0).cast(dtype)).cast("string")  # -0.0 counts as 0.0
    return cell(name).cast("string") if isinstance(dtype, T.BooleanType) else as_text(cell(name), dtype)


def missing_patterns(df: DataFrame, column: str, by: Sequence[str] | None = None) -> DataFrame:
    """`by_column, category, n_rows, missing_share`: how often `column` is missing per category.

    Covers every other text column, or those named in `by`. Empty when `column` has no
    missing cell.
    """
    require_column(df, column)
    texts = [
        f.name
        for f in df.schema.fields
        if f.name != column and isinstance(f.dataType, T.StringType) and (by is None or f.name in by)
    ]
    if not texts:
        schema = "by_column string, category string, n_rows long, missing_share double"
        return literal_rows(df.sparkSession, [], schema)
    gap = missing(df, column)
    cells = long_form(df, {c: cell(c) for c in texts}, ids=[gap.cast("int").alias("__gap")])
    shares = (
        cells.where(F.col("value").isNotNull())
        .groupBy(F.col("column").alias("by_column"), F.col("value").alias("category"))
        .agg(F.count("*").alias("n_rows"), F.avg("__gap").alias("missing_share"))
    )
    return shares.where(df.where(gap).select(F.lit(1)).exists())


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False, accuracy: int = ACCURACY
) -> DataFrame:
    """One row per column with quartiles, fences, counts beyond them and the outlier percentage.

    `columns` defaults to all numeric ones, which share the same scans. A column
    that is not numeric, or has no value, gets a `message` and no figures.
    """
    names = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if is_numeric(f.dataType)
    ]
    for name in names:
        require_column(df, name)
    numeric = [c for c in names if is_numeric(type_of(df, c))]
    notes = [(c, "" if c in numeric else "not numeric: quartiles do not apply") for c in names]
    asked = literal_rows(df.sparkSession, notes, "column string, note string")
    if not numeric:
        return _outlier_rows(asked, None)

    cells = long_form(df, {c: known(df, c).cast("double") for c in numeric})
    cells = cells.where(F.col("value").isNotNull())
    if approx:
        quartiles = cells.groupBy("column").agg(
            F.percentile_approx("value", [0.25, 0.75], accuracy).alias("quantiles")
        )
    else:
        quartiles = exact_quantiles(cells, ["column"], F.col("value"), [0.25, 0.75], few_groups=True)
    q1, q3 = F.get("quantiles", F.lit(0)), F.get("quantiles", F.lit(1))
    fences = quartiles.select(
        "column",
        q1.alias("q1"),
        q3.alias("q3"),
        (q3 - q1).alias("iqr"),
        (q1 - FENCE * (q3 - q1)).alias("lower_bound"),
        (q3 + FENCE * (q3 - q1)).alias("upper_bound"),
    )
    # One row per numeric column: the broadcast is bounded by the schema.
    counted = (
        cells.join(F.broadcast(fences), "column")
        .groupBy("column", "q1", "q3", "iqr", "lower_bound", "upper_bound")
        .agg(
            F.count_if(F.col("value") < F.col("lower_bound")).alias("n_lower"),
            F.count_if(F.col("value") > F.col("upper_bound")).alias("n_upper"),
            F.count("*").alias("n_valid"),
        )
    )
    return _outlier_rows(asked, counted)


def _outlier_rows(asked: DataFrame, counted: DataFrame | None) -> DataFrame:
    figures = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]
    counts = ["n_lower", "n_upper", "n_valid"]
    if counted is None:
        joined = asked.withColumns(
            {**{c: F.lit(None).cast("double") for c in figures}, **{c: F.lit(None).cast("long") for c in counts}}
        )
    else:
        joined = asked.join(F.broadcast(counted), "column", "left")
    share = F.try_divide((F.col("n_lower") + F.col("n_upper")) * 100.0, F.col("n_valid"))
    return joined.select(
        "column",
        *figures,
        *counts,
        share.alias("outlier_percentage"),
        F.when(F.col("note") != "", F.col("note")).when(F.col("n_valid").isNull(), "no valid values").alias("message"),
    )
