"""Profile of a table: one row per column, and the single-column questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.cells import (
    DIGEST_FROM,
    NESTED,
    as_text,
    cell,
    is_float,
    key_text,
    known,
    literal_rows,
    long_form,
    missing,
    plain_key,
    type_of,
)
from tidemark.functions.guards import require_column

Test = Callable[[Column], Column]  # of a value, to true or false


@dataclass(frozen=True)
class TextTest:
    """A test of texts. `may` is cheap and true wherever `holds` is; `core` is what `holds` looks at."""

    may: Test
    core: Test
    holds: Test


CORE = 128  # characters up to which a long cell's core travels with its digest

DICTIONARY = "position int, column string, dtype string"


def column_dictionary(df: DataFrame) -> DataFrame:
    """One row per column, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return literal_rows(df.sparkSession, rows, DICTIONARY)


def _family(dtype: T.DataType) -> str:
    """Columns of one family have a common type for their values."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "whole"
    if is_float(dtype):
        return "float"
    if isinstance(dtype, (T.StringType, T.BinaryType, *NESTED)):
        return "text"
    return dtype.simpleString()


def _family_key(df: DataFrame, name: str) -> Column:
    """An equal value for equal cells, NULL for missing ones, in the family's type."""
    family = _family(type_of(df, name))
    if family == "whole":
        return cell(name).cast("long")
    if family == "float":
        return known(df, name).cast("double")
    if family == "text":
        return key_text(df, name)
    return cell(name)


def value_counts(
    df: DataFrame, columns: Sequence[str], tests: Mapping[str, Mapping[str, Test | TextTest]] | None = None
) -> dict[str, DataFrame]:
    """Per family of types the rows `column, value, n`, and a column for each of the family's tests.

    Each family reads its own columns only, so every column is read once. Cells are counted
    per (column, value) before the shuffle: a value that fills a third of the table travels as
    one row per task, and a long text as its digest. Tests run once per distinct value. The digest of a
    long text says nothing of it, so its core goes along where one of the tests may hold.
    """
    families: dict[str, list[str]] = {}
    for name in columns:
        families.setdefault(_family(type_of(df, name)), []).append(name)
    out = {}
    for family, names in families.items():
        given = (tests or {}).get(family, {})
        if family != "text" or not given:
            counts = long_form(df, {n: _family_key(df, n) for n in names}).groupBy("column", "value").agg(F.count("*").alias("n"))
            out[family] = counts.withColumns({t: test(F.col("value")) for t, test in given.items()})
            continue
        cells = long_form(df, {n: _tested_key(df, n, given) for n in names}).select("column", "value.*")
        own = [f"core_{t}" for t in given] + [f"cell_{t}" for t in given]
        counts = cells.groupBy("column", "value", "long", *own).agg(F.count("*").alias("n"))
        verdicts = {
            t: F.when(F.col("long"), F.coalesce(F.col(f"cell_{t}"), test.holds(F.col(f"core_{t}")), F.lit(False))).otherwise(
                test.holds(test.core(F.col("value")))
            )
            for t, test in given.items()
        }
        out[family] = counts.withColumns(verdicts).drop("long", *own)
    return out


def _tested_key(df: DataFrame, name: str, tests: Mapping[str, TextTest]) -> Column:
    """The key of a text cell. Beside a digest, for each test the cell's core if it may hold, or the verdict if that is long."""
    text = plain_key(df, name)
    long = F.coalesce(F.length(text) >= DIGEST_FROM, F.lit(False))
    cores, verdicts = [], []
    for t, test in tests.items():
        core = F.when(long & test.may(text), test.core(text))
        cores.append(F.when(F.length(core) <= CORE, core).alias(f"core_{t}"))
        verdicts.append(F.when(F.length(core) > CORE, test.holds(core)).alias(f"cell_{t}"))
    return F.struct(key_text(df, name).alias("value"), long.alias("long"), *cores, *verdicts)


def column_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    text: Mapping[str, TextTest] | None = None,
    whole: Mapping[str, Test] | None = None,
) -> DataFrame:
    """`column, n_rows, n_nulls, n_unique` for the named columns.

    `text` and `whole` name tests of the values of text and whole-number columns; each becomes a
    column with the number of rows that pass.
    """
    tests = {"text": text or {}, "whole": whole or {}}
    names = [n for given in tests.values() for n in given]

    def summary(family: str, counts: DataFrame) -> DataFrame:
        given = tests.get(family, {})
        passed = {n: F.sum(F.when(F.col(n), F.col("n"))) if n in given else F.lit(None) for n in names}
        return counts.groupBy("column").agg(
            F.sum("n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
            F.count("value").alias("n_unique"),
            *[F.coalesce(total.cast("long"), F.lit(0)).alias(n) for n, total in passed.items()],
        )

    parts = [summary(f, c) for f, c in value_counts(df, list(columns or df.columns), tests).items()]
    return reduce(DataFrame.unionByName, parts)


def _one_pass_counts(df: DataFrame) -> DataFrame:
    """The same with approximate distinct counts: one aggregation, no shuffle of data."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(known(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
        *[F.approx_count_distinct(key_text(df, c)).alias(f"u{i}") for i, c in enumerate(df.columns)],
    )
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col("rows").alias("n_rows"),
                        (F.col("rows") - F.col(f"c{i}")).alias("n_nulls"),
                        F.col(f"u{i}").alias("n_unique"),
                    )
                    for i, c in enumerate(df.columns)
                ]
            )
        )
    )


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """The first `n` rows; name an order where the same rows must come back."""
    if order_by:
        df = df.orderBy(*[cell(c) for c in order_by])
    return df.limit(n)


def samples(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """`column, sample`: the cells of the first `n` rows as text, nulls included."""
    head = preview(df, n, order_by)
    texts = {c: as_text(known(df, c), type_of(df, c)) for c in df.columns}
    cells = long_form(head, texts, ids=[F.monotonically_increasing_id().alias("__row")])
    ordered = F.sort_array(F.collect_list(F.struct("__row", "value")))
    return cells.groupBy("column").agg(F.transform(ordered, lambda x: x["value"]).alias("sample"))


def profile(
    df: DataFrame, sample_rows: int = 5, order_by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """`position, column, dtype, n_rows, n_columns, n_nulls, n_unique, sample`, a row per column.

    `approx=True` estimates the distinct counts and so needs no shuffle of the cells.
    """
    counts = _one_pass_counts(df) if approx else column_counts(df)
    # One row per table column on each side, so the broadcasts are bounded by the schema.
    return (
        column_dictionary(df)
        .join(F.broadcast(counts), "column", "left")
        .join(F.broadcast(samples(df, sample_rows, order_by)), "column", "left")
        .select(
            "position",
            "column",
            "dtype",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
            F.coalesce("n_nulls", F.lit(0)).alias("n_nulls"),
            F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
            F.coalesce("sample", F.array().cast("array<string>")).alias("sample"),
        )
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def column_count(df: DataFrame) -> int:
    return len(df.columns)


def column_names(df: DataFrame) -> list[str]:
    return df.columns


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def column_type(df: DataFrame, column: str) -> str:
    require_column(df, column)
    return type_of(df, column).simpleString()


def null_counts(df: DataFrame) -> DataFrame:
    """`column, n_nulls`: one aggregation over the table."""
    row = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in df.columns])
    return row.unpivot([], [cell(c) for c in df.columns], "column", "n_nulls")


def unique_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`column, n_unique`: exact distinct non-missing values; 0 on an empty table."""
    names = list(columns or df.columns)
    for name in names:
        require_column(df, name)
    counts = column_counts(df, names).select("column", "n_unique")
    wanted = column_dictionary(df.select(*[cell(n) for n in names])).select("column")
    return wanted.join(F.broadcast(counts), "column", "left").fillna(0, ["n_unique"])


def column_sample(df: DataFrame, column: str, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first `n` cells of one column."""
    require_column(df, column)
    return preview(df, n, order_by).select(cell(column))


def has_nulls(df: DataFrame, column: str) -> DataFrame:
    """One row, `has_nulls`. The filter reaches the file statistics and one hit ends a task."""
    require_column(df, column)
    hit = df.where(missing(df, column)).select(F.lit(1).alias("hit")).limit(1)
    return hit.agg((F.count("hit") > 0).alias("has_nulls"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """All distinct values, missing included once. Stays a DataFrame, as there is no bound."""
    require_column(df, column)
    return df.select(known(df, column).alias(column)).distinct()
