"""Profiles that are kept and merged: a state for each batch of rows, instead of a scan of all rows.

A state is a small table, one row per column: counts, the extremes and a HyperLogLog sketch of the distinct
values. States of batches merge to the state of all their rows; all figures but the distinct counts
are exact. `profile.profile` remains the exact way over a whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.cells import cell, is_numeric, key_text, missing, type_of

SKETCH_LOG = 14  # log2 of the sketch's registers: a standard error of about 0.7 %


def profile_state(df: DataFrame) -> DataFrame:
    """`position, column, dtype, n_rows, n_nulls, n_longest, low, high, total, distinct`: one aggregation, no shuffle of cells.

    `low`, `high` and `total` (of numeric columns, as doubles) leave missing cells out; `n_longest` is the
    length of the longest text form; `distinct` is the sketch.
    """
    sums = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        known = F.when(~missing(df, c), cell(c))
        number = known.cast("double") if is_numeric(type_of(df, c)) else F.lit(None).cast("double")
        sums += [
            F.count_if(missing(df, c)).alias(f"x{i}"),
            F.max(F.length(key_text(df, c))).alias(f"l{i}"),
            F.min(number).alias(f"a{i}"),
            F.max(number).alias(f"b{i}"),
            F.sum(number).alias(f"s{i}"),
            F.hll_sketch_agg(key_text(df, c), SKETCH_LOG).alias(f"d{i}"),
        ]
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("rows").alias("n_rows"),
            F.col(f"x{i}").alias("n_nulls"),
            F.col(f"l{i}").alias("n_longest"),
            F.col(f"a{i}").alias("low"),
            F.col(f"b{i}").alias("high"),
            F.col(f"s{i}").alias("total"),
            F.col(f"d{i}").alias("distinct"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all the batches' rows. Columns that a batch lacks count as missing cells there.

    A column must have one type in all batches.
    """
    marked = [s.withColumn("batch", F.lit(i)) for i, s in enumerate(states)]
    every = reduce(DataFrame.unionByName, marked)
    sizes = every.groupBy("batch").agg(F.max("n_rows").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    kinds = F.collect_set("dtype")
    message = F.concat(F.lit("Column of several types: "), F.col("column"))
    merged = every.groupBy("column").agg(
        F.min("position").alias("position"),
        F.min("dtype").alias("dtype"),
        F.size(kinds).alias("kinds"),
        F.sum("n_rows").alias("own_rows"),
        F.sum("n_nulls").alias("own_nulls"),
        F.max("n_longest").alias("n_longest"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("total").alias("total"),
        F.hll_union_agg("distinct").alias("distinct"),
    )
    return merged.select(
        "position",
        "column",
        F.when(F.col("kinds") > 1, F.raise_error(message).cast("string")).otherwise(F.col("dtype")).alias("dtype"),
        sizes.cast("long").alias("n_rows"),
        (sizes - F.col("own_rows") + F.col("own_nulls")).cast("long").alias("n_nulls"),
        "n_longest",
        "low",
        "high",
        "total",
        "distinct",
    )


def state_profile(state: DataFrame) -> DataFrame:
    """`position, column, dtype, n_rows, n_nulls, n_unique, low, high, mean` of a state; `n_unique` is estimated."""
    n_known = F.col("n_rows") - F.col("n_nulls")
    return state.select(
        "position",
        "column",
        "dtype",
        "n_rows",
        "n_nulls",
        F.hll_sketch_estimate("distinct").alias("n_unique"),
        "low",
        "high",
        F.try_divide(F.col("total"), n_known.cast("double")).alias("mean"),
    )
