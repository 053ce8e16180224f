"""Date layouts by the votes of a whole column: day first or month first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions import convert
from tidemark.functions.cells import cell, literal_rows
from tidemark.functions.guards import require_column

VOTES_SCHEMA = "column string, n_cells long, n_day_first long, n_month_first long, n_ambiguous long, n_neither long, chosen string"


def month_first(formats: Sequence[str] = convert.DATE_FORMATS) -> tuple[str, ...]:
    """The layouts with day and month exchanged where the day comes first."""
    return tuple(f"M{f[1]}d{f[3:]}" if f[:1] == "d" and f[2:3] == "M" else f for f in formats)


def layout_votes(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = convert.DATE_FORMATS) -> DataFrame:
    """`column, n_cells, n_day_first, n_month_first, n_ambiguous, n_neither, chosen` for text columns, in one pass.

    `n_day_first` cells fit a layout of `formats`, `n_month_first` one of the same with day and month
    exchanged, `n_ambiguous` both with different dates, `n_neither` none. The order that explains more
    cells is chosen for the whole column, day first where both explain as many.
    """
    for c in columns:
        require_column(df, c)
    other = month_first(formats)
    sums = []
    for i, c in enumerate(columns):
        text = F.trim(cell(c).cast("string"))
        day, month = convert.to_datetime(text, T.StringType(), formats), convert.to_datetime(text, T.StringType(), other)
        sums += [
            F.count(text).alias(f"n{i}"),
            F.count(day).alias(f"d{i}"),
            F.count(month).alias(f"m{i}"),
            F.count_if(day != month).alias(f"a{i}"),
            F.count_if(text.isNotNull() & day.isNull() & month.isNull()).alias(f"x{i}"),
        ]
    if not columns:
        return literal_rows(df.sparkSession, [], VOTES_SCHEMA)
    row = df.agg(*sums)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("n_cells"),
            F.col(f"d{i}").alias("n_day_first"),
            F.col(f"m{i}").alias("n_month_first"),
            F.col(f"a{i}").alias("n_ambiguous"),
            F.col(f"x{i}").alias("n_neither"),
            F.when(F.col(f"m{i}") > F.col(f"d{i}"), "month_first").otherwise("day_first").alias("chosen"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*rows)))


def voted_formats(df: DataFrame, column: str, formats: Sequence[str] = convert.DATE_FORMATS) -> tuple[str, ...]:
    """The consistent set of layouts for one column, for `convert_column_to_datetime` and plans; one aggregation."""
    chosen = layout_votes(df, [column], formats).first()["chosen"]
    return month_first(formats) if chosen == "month_first" else tuple(formats)
