"""Joins of a large table with a lookup table, safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.cells import NESTED, cell, type_of

# A lookup is broadcast only when its measured size is within both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024

# Beyond them the tables are shuffled by the key. A key with at least this share of the large
# side's rows is hot (there are at most `1 / share` such keys), and its rows are spread over
# `SALTS` join partitions.
HOT_SHARE = 0.001
SALTS = 64


def _width(df: DataFrame, name: str) -> Column:
    """Bytes of one cell, about."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(cell(name)), F.lit(0)) + 16
    if isinstance(dtype, NESTED):
        return F.coalesce(F.octet_length(F.to_json(cell(name))), F.lit(0)) + 16
    return F.lit(16)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a lookup by one aggregation, of which one row reaches the driver."""
    width = reduce(lambda a, b: a + b, [_width(df, c) for c in df.columns], F.lit(0))
    size = df.agg(F.count("*").alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= max_bytes


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[cell(k) for k in keys])


def hot_hashes(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys with at least this share of the rows; there are at most `1 / share`.

    Rows are counted by hash where they are read and then by many tasks; only hot hashes get further.
    """
    counts = df.groupBy(_hash(keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return [r["h"] for r in counts.where(F.col("n") >= total * F.lit(share)).select("h").collect()]


def spread_hot(
    left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], salts: int = SALTS
) -> tuple[DataFrame, DataFrame]:
    """Add a `__salt` to both sides that a join must match besides the keys.

    It is 0 but for hot keys. Rows of a hot key take the number of the input partition on the
    left and are there once per salt on the right, which has one row per key. The partition
    number does not hang on the row, so even identical rows are spread, and a task that runs
    again gives the same salt.
    """
    hot = hot_hashes(left, left_keys)
    if not hot:
        return left.withColumn("__salt", F.lit(0)), right.withColumn("__salt", F.lit(0))
    spread = F.when(_hash(left_keys).isin(hot), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    copies = F.when(_hash(right_keys).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("__salt", spread), right.withColumn("__salt", F.explode(copies))


def matches(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Null-safe equality on every pair, which Spark runs as an equi-join."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    small: bool | None = None,
    spread: bool = True,
) -> DataFrame:
    """Join with a table that holds one row per key, of the same type on both sides.

    `small=True` is for lookups whose size is bounded by construction (one row per table
    column or per listed literal); otherwise the size is measured first. `spread=False` looks for
    no hot keys beforehand, so that no job runs, and leaves skewed partitions to Spark.
    """
    if small is None:
        small = fits_broadcast(right)
    if small:
        return left.join(F.broadcast(right), list(on), how)
    if not spread:
        return left.join(right, list(on), how)
    left, right = spread_hot(left, right, on, on)
    return left.join(right, [*on, "__salt"], how).drop("__salt")
